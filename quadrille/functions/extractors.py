"""The extension point: (image, mask) to a vector of declared length."""

from __future__ import annotations

from abc import ABC, abstractmethod

import numpy as np


class ExtractionError(RuntimeError):
    """An extractor broke its contract, or was given what it cannot describe."""


def validated(vector, dim: int, technique: str) -> np.ndarray:
    """A flat float64 vector of dim finite values."""
    out = np.array(vector, np.float64).ravel()
    if out.size != dim:
        raise ExtractionError(f"{technique} returned {out.size} features but declares {dim}")
    bad = np.flatnonzero(~np.isfinite(out))
    if bad.size:
        raise ExtractionError(f"{technique} returned {bad.size} non-finite value(s) at indices {bad[:10].tolist()}")
    return out


def inside(mask: np.ndarray, technique: str) -> np.ndarray:
    """The mask as booleans; an empty one is refused."""
    out = np.asarray(mask) > 0
    if not out.any():
        raise ExtractionError(f"{technique} was given an empty fruit mask")
    return out


class Extractor(ABC):
    """Subclasses set name, short_name and dim, and extract.

    Those whose vector follows from counts of an image set counts, the same for
    all that count alike, and tally and from_tally: several settings then cost one look at the image.
    """

    name = "unnamed"
    short_name = "T?"
    dim = 0
    counts: tuple | None = None

    @abstractmethod
    def extract(self, image: np.ndarray, mask: np.ndarray) -> np.ndarray: ...

    def tally(self, image: np.ndarray, mask: np.ndarray):
        raise NotImplementedError(f"{self.short_name} does not count")

    def from_tally(self, counts) -> np.ndarray:
        raise NotImplementedError(f"{self.short_name} does not count")

    def described(self, counts) -> np.ndarray:
        return validated(self.from_tally(counts), self.dim, self.short_name)

    def __call__(self, image: np.ndarray, mask: np.ndarray) -> np.ndarray:
        return validated(self.extract(image, mask), self.dim, self.short_name)

    def describe(self) -> str:
        return f"{self.short_name}: {self.name} ({self.dim} dimensions)"

    @property
    def feature_names(self) -> list[str]:
        return [f"{self.short_name}_{i:03d}" for i in range(self.dim)]


class MeanColour(Extractor):
    """A small descriptor for examples: mean and spread of each channel inside the mask, and coverage."""

    name, short_name, dim = "mean colour", "MC", 7

    def extract(self, image, mask):
        pixels = image[inside(mask, self.short_name)].astype(np.float64)
        return np.concatenate([pixels.mean(axis=0), pixels.std(axis=0), [np.mean(np.asarray(mask) > 0)]])
