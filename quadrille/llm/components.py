"""Connected components by alternating large and small stars (Kiveris et al., 2014).

Edges stay distributed; each round is two aggregations joined back to the
edges, written durably. The smallest node of a component ends as the centre of
a star. A node with very many edges is met by partial aggregation, and by joins
that deal its edges over tasks, never by gathering its neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import durable, spread_join


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component for every node of edges (u, v), both long and not null; component is the smallest node reachable.

    Loops and repeated edges change nothing; no edges give no rows.
    """
    edges = durable(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    before = _state(edges)
    while before[0]:
        both = _both(edges)
        least = durable(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"))
        larger = spread_join(both.where("v > u"), least.select("u", "m"), ["u"], least.select("u", "n"))
        large = durable(larger.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        # every edge now has u > v: the small star hangs u and its smaller neighbours on the least of them
        least = durable(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        smaller = spread_join(large, least.select("u", "m"), ["u"], least.select("u", "n"))
        small = smaller.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = durable(small)
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
