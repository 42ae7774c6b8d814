"""Pictures drawn from ids, for queries that run the pixel kernels over tables without images."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

SIDE = 24


def discs(ids: DataFrame) -> DataFrame:
    """id, plane: SIDE rows of SIDE grey bytes; a disc on a plain ground with a fixed pattern of noise. Polarity, size and brightness follow from the id."""

    def draw(batches):
        y, x = np.mgrid[:SIDE, :SIDE]
        away = (x - SIDE // 2) ** 2 + (y - SIDE // 2) ** 2
        for batch in batches:
            planes = []
            for i in batch.id:
                lit = (away <= (1 + i % 17) ** 2) == (i % 2 == 0)
                planes.append((np.where(lit, 180 + i % 40, 30 + i % 20) + (x * 7 + y * 13 + i * 31) % 8).astype(np.uint8).tobytes())
            yield pd.DataFrame({"id": batch.id, "plane": planes})

    return ids.select("id").mapInPandas(draw, "id long, plane binary")


def with_kernel(pictures: DataFrame, kernel: Callable[[np.ndarray], Iterable[tuple]], schema: str) -> DataFrame:
    """id and, in rows of schema, what kernel makes of each plane."""
    names = ["id", *[c.split()[0] for c in schema.split(", ")]]

    def work(batches):
        for batch in batches:
            yield pd.DataFrame([(i, *row) for i, plane in zip(batch.id, batch.plane, strict=True) for row in kernel(np.frombuffer(plane, np.uint8).reshape(SIDE, SIDE))], columns=names)

    return pictures.mapInPandas(work, "id long, " + schema)


def checksum(plane: np.ndarray) -> tuple[int, int]:
    """The sum of a plane, and one that tells places apart."""
    y, x = np.mgrid[: plane.shape[0], : plane.shape[1]]
    v = plane.astype(np.int64)
    return int(v.sum()), int((v * (x * 31 + y * 17 + 1)).sum())
