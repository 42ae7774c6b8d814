"""Count-min sketches built by partition, merged by block, and broadcast.

Each task counts its hashes in a sketch of its own, kept as the cells that hold
something, and sends it on by block, compressed, whenever FLUSH hashes are in. Blocks meet by number, in two rounds when there
are many tasks, so no task sees more than a bounded number of them. A merged
cell is a level of four bits: counts up to 3 as they are, then one more level
for each doubling. A level is never that of less than the true count (up to
255 from one flush); a sketch has at most MAX_CELLS cells in all, so that it may
be broadcast whatever the input. Beyond about that many different hashes it
tells less apart, which costs its users time but no result.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textgrid import mix, slices

MIN_CELLS, MAX_CELLS = 1 << 16, 1 << 27  # over all rows: at most 64 MB
BLOCK = 1 << 20
FLUSH = 1 << 21
LISTED = 100_000  # keys that are sent to all tasks as they are; of more, a sketch
_ROUND = 256  # partial sketches that meet in one task at most, about

_SCHEMA = "part int, row int, block int, cells binary"


def _cells(hashes: np.ndarray, row: int, cells: int) -> np.ndarray:
    return (mix(hashes + np.uint64(0xA0761D6478BD642F * (row + 1) & (1 << 64) - 1)) & np.uint64(cells - 1)).astype(np.uint32)


def level(count: int) -> int:
    """The level of a count: below it, a hash certainly occurs less often."""
    return count if count < 4 else min(15, 1 + count.bit_length())


def _packed_levels(counts: np.ndarray) -> np.ndarray:
    doublings = np.frexp(counts.astype(np.float64))[1]
    levels = np.where(counts < 4, counts, np.minimum(15, 1 + doublings)).astype(np.uint8)
    return levels[0::2] | levels[1::2] << 4


class Sketch:
    """levels(hashes): for each, at least the level of its true count. load: hashes for each cell, about; a hash must
    be far above it before its level says that it is frequent."""

    def __init__(self, cells: int, depth: int, blocks: list[tuple[int, int, bytes]], load: float = 0.0):
        self.cells, self.depth, self.blocks, self.load, self._table = cells, depth, blocks, load, None

    def __getstate__(self):
        return self.__dict__ | {"_table": None}

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        if self._table is None:
            size = min(BLOCK, self.cells) // 2
            self._table = np.zeros((self.depth, self.cells // 2), np.uint8)
            for row, block, packed in self.blocks:
                self._table[row, block * size : (block + 1) * size] = np.frombuffer(pa.decompress(packed, size, codec="zstd"), np.uint8)
            self.blocks = []  # a worker needs them no more
        out = np.full(len(hashes), 15, np.uint8)
        for row in range(self.depth):
            at = _cells(hashes, row, self.cells)
            two = self._table[row][at >> np.uint32(1)]
            np.minimum(out, np.where(at & np.uint32(1), two >> 4, two & 15), out=out)
        return out


def cells_for(expected: int, depth: int) -> int:
    """Cells of each row: a power of two, in all rows at least twice the expected number of hashes for each row, within the bounds."""
    return max(MIN_CELLS, min(MAX_CELLS // depth, 1 << max(1, 2 * int(expected) - 1).bit_length()))


def _pack(cells: np.ndarray, counts: np.ndarray) -> bytes:
    """Rising cells of one block and their counts."""
    gaps = np.diff(cells, prepend=0).astype(np.uint32)
    raw = gaps.view(np.uint8).reshape(-1, 4).T.tobytes() + counts.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(cells).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(packed[:4], "little")
    raw = np.frombuffer(pa.decompress(packed[4:], 8 * n, codec="zstd"), np.uint8)
    gaps, counts = (np.ascontiguousarray(raw[a : a + 4 * n].reshape(4, n).T).view(np.uint32).ravel() for a in (0, 4 * n))
    return np.cumsum(gaps), counts


def _row(part: int, row: int, block: int, packed: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([row], pa.int32()), pa.array([block], pa.int32()), pa.array([packed], pa.binary())], names=["part", "row", "block", "cells"])


def _totals(batches, size: int) -> tuple[dict[tuple[int, int], np.ndarray], int]:
    total: dict[tuple[int, int], np.ndarray] = {}
    part = 0
    for batch in batches:
        for part, row, block, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (row, block) not in total:
                total[row, block] = np.zeros(size, np.uint32)
            cells, counts = _unpack(packed)
            total[row, block][cells] += counts
    return total, part


def _bytes(setting: str) -> int:
    """A size as Spark writes it."""
    number, unit = re.fullmatch(r"(\d+)\s*([kmgtp]?)i?b?", setting.strip().lower()).groups()
    return max(1, int(number) << " kmgtp".index(unit or " ") * 10)


def build(df: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray], expected: int, depth: int) -> Sketch:
    """The sketch of all values that hashes() gives for the Arrow batches of df, each counted as often as it is given. A column text is worked on in slices."""
    cells = cells_for(expected, depth)
    size, sliced = min(BLOCK, cells), "text" in df.columns
    # as many partial sketches as there are splits of the input, or flushes
    split = df.sparkSession.conf.get("spark.sql.files.maxPartitionBytes")
    rounds = 1 + max(4 * expected // _bytes(split), expected // FLUSH) // _ROUND

    def count(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() % rounds

        def flush(held):
            values = np.concatenate(held)
            for row in range(depth):
                at, n = np.unique(_cells(values, row, cells), return_counts=True)
                edges = np.searchsorted(at, np.arange(0, cells + 1, size))
                for block in np.flatnonzero(np.diff(edges)):
                    s = slice(edges[block], edges[block + 1])
                    yield _row(part, row, int(block), _pack(at[s] - np.uint32(block * size), np.minimum(n[s], 255)))

        held, waiting = [], 0
        for batch in slices(batches) if sliced else batches:
            held.append(hashes(batch))
            waiting += len(held[-1])
            if waiting >= FLUSH:
                yield from flush(held)
                held, waiting = [], 0
        if waiting:
            yield from flush(held)

    def merge(batches):
        total, part = _totals(batches, size)
        for (row, block), counts in total.items():
            at = np.flatnonzero(counts)
            yield _row(part, row, block, _pack(at, counts[at]))

    def finish(batches):
        for (row, block), counts in _totals(batches, size)[0].items():
            yield _row(0, row, block, pa.compress(_packed_levels(counts).tobytes(), codec="zstd", asbytes=True))

    found = df.mapInArrow(count, _SCHEMA)
    if rounds > 1:
        found = found.repartition("part", "row", "block").mapInArrow(merge, _SCHEMA)
    found = found.repartition("row", "block").mapInArrow(finish, _SCHEMA)
    # one row of at most BLOCK / 2 bytes for each block, so at most MAX_CELLS / 2 bytes whatever the input
    return Sketch(cells, depth, sorted((r.row, r.block, bytes(r.cells)) for r in found.collect()), expected / cells)


def _ids(column: pa.Array) -> np.ndarray:
    return mix(column.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64))


def parted(df: DataFrame, key: str, wanted: DataFrame, total: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """df in two: the rows whose key, an integer, may be in the one column of wanted - all of those, and few others - and the rest.

    Before a shuffle of wide rows of which a join needs few. Up to LISTED keys are sent as a list, more as a sketch. Where that may be half of them or more, df itself and None.
    total: the rows of df, if they are known.
    """
    n = wanted.count()
    if 2 * n > (df.count() if total is None else total):
        return df, None
    if n <= LISTED:
        listed = F.broadcast(wanted.toDF(key))
        return df.join(listed, key, "left_semi").select(*df.columns), df.join(listed, key, "left_anti").select(*df.columns)
    sent = df.sparkSession.sparkContext.broadcast(build(wanted.select(F.col(wanted.columns[0]).cast("long").alias("id")), lambda batch: _ids(batch.column("id")), 4 * n, depth=1))

    def side(here):
        def pick(batches):
            for batch in batches:
                yield batch.filter(pa.array((sent.value.levels(_ids(batch.column(key))) > 0) == here))

        return pick

    return df.mapInArrow(side(True), df.schema), df.mapInArrow(side(False), df.schema)


def only_some(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The first part of the above."""
    return parted(df, key, wanted)[0]


def text_bytes(df: DataFrame, text: str = "text") -> int:
    return int(df.agg(F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0))).first()[0])
