"""Three descriptor families for segmented fruit: colour, co-occurrence texture, local patterns with blemishes.

They go beyond what is required to match: only their lengths and parameters are
given elsewhere, so the choice of moments, properties and statistics is ours.
"""

from __future__ import annotations

import numpy as np

from ..settings import Settings
from .extractors import Extractor, inside
from .pixels import _swept, label, to_lab


def to_hsv(image: np.ndarray) -> np.ndarray:
    """Hue in half degrees (0-179), saturation and value in bytes."""
    b, g, r = (image[..., k].astype(np.float64) for k in range(3))
    v, low = np.maximum(np.maximum(b, g), r), np.minimum(np.minimum(b, g), r)
    d = v - low
    safe = np.where(d > 0, d, 1)
    h = np.where(v == r, (g - b) / safe, np.where(v == g, 2 + (b - r) / safe, 4 + (r - g) / safe))
    h = np.where(d > 0, h * 30 % 180, 0)
    s = np.where(v > 0, d * 255 / np.where(v > 0, v, 1), 0)
    return np.stack([np.rint(h) % 180, np.rint(s), v], axis=-1).astype(np.uint8)


#: Colour spaces, and the number of values of their channels.
SPACES = {"HSV": (to_hsv, (180, 256, 256)), "LAB": (to_lab, (256, 256, 256)), "RGB": (lambda image: image[..., ::-1], (256, 256, 256))}


class Colour(Extractor):
    """Histograms of hue, saturation and value, and mean, deviation and skewness of each; washed-out and glaring pixels stay out if others are left.

    In another space the same pixels are described by its channels.
    """

    name, short_name, dim = "HSV colour", "T1", 105

    def __init__(self, bins: int = 32, s_min: int = 40, v_max: int = 240, space: str = "HSV"):
        if space.upper() not in SPACES:
            raise ValueError(f"a colour space is one of {', '.join(SPACES)}: {space!r}")
        self.bins, self.s_min, self.v_max, self.space = bins, s_min, v_max, space.upper()
        self.dim, self.name = 3 * bins + 9, f"{self.space} colour"
        self.counts = ("colour", self.space, s_min, v_max)

    def tally(self, image, mask):
        """How many pixels have each value of each channel: rows of 256."""
        keep = inside(mask, self.short_name)
        hsv = to_hsv(image)[keep]
        good = (hsv[:, 1] >= self.s_min) & (hsv[:, 2] <= self.v_max)
        x = SPACES[self.space][0](image)[keep]
        x = x[good] if good.any() else x
        return np.stack([np.bincount(x[:, k], minlength=256) for k in range(3)])

    def from_tally(self, counts):
        n, value = counts[0].sum(), np.arange(256.0)
        shares = [np.histogram(value, bins=self.bins, range=(0, top), weights=c)[0] / n for c, top in zip(counts, SPACES[self.space][1], strict=True)]
        mean = counts @ value / n
        apart = value[None, :] - mean[:, None]
        sd = np.sqrt((counts * apart**2).sum(axis=1) / n)
        skew = np.where(sd > 0, (counts * apart**3).sum(axis=1) / n / np.where(sd > 0, sd, 1) ** 3, 0)
        return np.concatenate([*shares, mean, sd, skew])

    def extract(self, image, mask):
        return self.from_tally(self.tally(image, mask))


FINEST = 256  # grey levels of a tally


class CoOccurrence(Extractor):
    """Contrast, dissimilarity, homogeneity, energy and correlation of grey-level pairs at each distance and angle (Haralick et al., 1973).

    averaged: over the angles of a distance. tallied: distances and angles that are counted, if others share the counts.
    """

    name, short_name, dim = "grey-level co-occurrence", "T2", 40

    def __init__(self, levels: int = 32, distances: tuple[int, ...] = (1, 2), angles: tuple[int, ...] = (0, 45, 90, 135), averaged: bool = False, tallied: tuple[tuple[int, ...], tuple[int, ...]] | None = None):
        self.levels, self.distances, self.angles, self.averaged = levels, tuple(distances), tuple(angles), averaged
        self.dim = 5 * len(self.distances) * (1 if averaged else len(self.angles))
        self.counts = ("pairs", *(tallied or (self.distances, self.angles)))

    def tally(self, image, mask):
        """For each distance and angle, the pairs of grey bytes that occur, as one number, and how often."""
        keep = inside(mask, self.short_name)
        grey = np.rint(image.astype(np.float64) @ [0.114, 0.587, 0.299]).astype(int)
        height, width = grey.shape
        out = {}
        for d in self.counts[1]:
            for angle in self.counts[2]:
                dy, dx = -int(np.rint(d * np.sin(np.deg2rad(angle)))), int(np.rint(d * np.cos(np.deg2rad(angle))))
                a = (slice(max(0, -dy), height - max(0, dy)), slice(max(0, -dx), width - max(0, dx)))
                b = (slice(max(0, dy), height + min(0, dy)), slice(max(0, dx), width + min(0, dx)))
                both = keep[a] & keep[b]
                out[d, angle] = np.unique(grey[a][both] * FINEST + grey[b][both], return_counts=True)
        return out

    def _figures(self, pairs, times) -> list[float]:
        # grey bytes become levels, and pairs that become equal are one
        i, j = np.mgrid[: self.levels, : self.levels]
        merged = pairs // FINEST * self.levels // 256 * self.levels + pairs % FINEST * self.levels // 256
        p = np.bincount(merged, weights=times, minlength=self.levels**2).reshape(self.levels, self.levels)
        p = p + p.T
        p /= max(p.sum(), 1)
        mi, mj = (p * i).sum(), (p * j).sum()
        si, sj = np.sqrt((p * (i - mi) ** 2).sum()), np.sqrt((p * (j - mj) ** 2).sum())
        correlation = (p * (i - mi) * (j - mj)).sum() / (si * sj) if si * sj > 1e-12 else 1.0
        return [(p * (i - j) ** 2).sum(), (p * abs(i - j)).sum(), (p / (1 + (i - j) ** 2)).sum(), np.sqrt((p**2).sum()), correlation]

    def from_tally(self, counts):
        found = np.array([[self._figures(*counts[d, angle]) for angle in self.angles] for d in self.distances])
        return (found.mean(axis=1) if self.averaged else found).ravel()

    def extract(self, image, mask):
        return self.from_tally(self.tally(image, mask))


def uniform_patterns(grey: np.ndarray, points: int, radius: int) -> np.ndarray:
    """Rotation-invariant uniform pattern of each pixel: 0 to points, and points + 1 for the others (Ojala et al., 2002)."""
    height, width = grey.shape
    y, x = np.mgrid[:height, :width].astype(np.float64)
    g = grey.astype(np.float64)
    bits = []
    for k in range(points):
        t = 2 * np.pi * k / points
        yy, xx = np.clip(y - radius * np.sin(t), 0, height - 1), np.clip(x + radius * np.cos(t), 0, width - 1)
        y0, x0 = np.floor(np.round(yy, 9)).astype(int), np.floor(np.round(xx, 9)).astype(int)
        y1, x1 = np.minimum(y0 + 1, height - 1), np.minimum(x0 + 1, width - 1)
        fy, fx = yy - y0, xx - x0
        value = (g[y0, x0] * (1 - fx) + g[y0, x1] * fx) * (1 - fy) + (g[y1, x0] * (1 - fx) + g[y1, x1] * fx) * fy
        bits.append(np.round(value - g, 6) >= 0)
    bits = np.stack(bits)
    changes = (bits != np.roll(bits, 1, axis=0)).sum(axis=0)
    return np.where(changes <= 2, bits.sum(axis=0), points + 1)


class PatternsAndBlemishes(Extractor):
    """Shares of uniform local patterns, and six figures of blemishes: pixels far from the median colour, opened, in parts of some size."""

    name, short_name, dim = "local patterns and blemishes", "T3", 34

    def __init__(self, patterns: tuple[tuple[int, int], ...] = ((8, 1), (16, 2)), hue: float = 20, saturation: float = 60, value: float = 60, open_kernel: tuple[int, int] = (3, 3), least: int = 10):
        self.patterns, self.far, self.open_kernel, self.least = patterns, (hue, saturation, value), open_kernel, least
        self.dim = sum(p + 2 for p, _ in patterns) + 6

    def extract(self, image, mask):
        keep = inside(mask, self.short_name)
        grey = np.rint(image.astype(np.float64) @ [0.114, 0.587, 0.299])
        shares = [np.bincount(uniform_patterns(grey, p, r)[keep], minlength=p + 2) / keep.sum() for p, r in self.patterns]
        hsv = to_hsv(image).astype(np.float64)
        middle = np.median(hsv[keep], axis=0)
        away = np.abs(hsv - middle)
        away[..., 0] = np.minimum(away[..., 0], 180 - away[..., 0])
        odd = keep & ((away[..., 0] > self.far[0]) & (hsv[..., 1] > self.far[1]) | (away[..., 1] > self.far[1]) | (away[..., 2] > self.far[2]))
        odd = _swept(_swept(odd, self.open_kernel, False), self.open_kernel, True) & keep
        parts, n = label(odd)
        area = np.bincount(parts.ravel(), minlength=n + 1)[1:]
        area = area[area >= self.least]
        spots = np.isin(parts, np.flatnonzero(np.bincount(parts.ravel(), minlength=n + 1) >= self.least)) & odd
        whole = keep.sum()
        darker = (middle[2] - hsv[..., 2][spots].mean()) / 255 if spots.any() else 0.0
        paler = (middle[1] - hsv[..., 1][spots].mean()) / 255 if spots.any() else 0.0
        return np.concatenate([*shares, [spots.sum() / whole, len(area), area.mean() / whole if len(area) else 0, area.max(initial=0) / whole, darker, paler]])


REGISTRY = {e.short_name: e for e in (Colour, CoOccurrence, PatternsAndBlemishes)}


def from_settings(settings: Settings) -> list[Extractor]:
    """The three extractors, with the parameters that the settings' sections t1_colour, t2_glcm and t3_lbp_blemish name."""
    one, two, three = (settings.extra.get(k, {}) for k in ("t1_colour", "t2_glcm", "t3_lbp_blemish"))
    return [Colour(**_named(one, _T1)), CoOccurrence(**_named(two, _T2)), PatternsAndBlemishes(**_named(three, _T3))]


# Names of parameters in a settings file, and here.
_T1 = {"bins": "bins", "s_min": "s_min", "v_max": "v_max", "colour_space": "space"}
_T2 = {"levels": "levels", "distances": "distances", "angles_deg": "angles", "angle_averaged": "averaged"}
_T3 = {"lbp_configs": "patterns", "hue_deviation": "hue", "saturation_deviation": "saturation", "value_deviation": "value", "open_kernel": "open_kernel", "min_blemish_area": "least"}


def _named(section: dict, names: dict[str, str]) -> dict:
    fixed = lambda v: tuple(map(fixed, v)) if isinstance(v, list) else v
    return {own: fixed(section[k]) for k, own in names.items() if k in section}
