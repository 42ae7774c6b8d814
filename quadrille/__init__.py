"""Image-experiment analytics on Spark."""
