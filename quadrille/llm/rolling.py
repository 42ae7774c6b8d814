"""Counts, sums, distinct values and exact ranks over windows of time, by merge-sort trees.

A tree stands over the points of a stretch of time, in time order: the node of
a run of 2^l points holds them sorted by value. A value is looked up once in the
root; from there each node tells, for a place in its array, how many of the
elements before it went to its left child, so that the place in a child follows
without another search (fractional cascading). The weight of values up to v
before a point is thus a walk down one path, a window is the difference of two,
and an exact rank is a binary search over values by such sums. Distinct values
are points of the window whose last equal point lies before it: a second tree,
over those places.

Points are dealt by key and cells of time, an eighth of the longest window
each, and go to all cells that may ask for them, nine at most; so a key with a third of all
rows is spread over as many cells as its time has. Equal points (key, time,
value, kind) are one with a weight before they move, and rows with equal key and
time are one question. A task works on the cells it has read completely, so
memory follows the different points of one key in nine eighths of the longest
window, some 12 bytes for each level of their tree. Keys are told apart by 64 bits of hash.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS = 8  # in the longest window
TOGETHER = 1 << 16  # points in a tree, about: cells are put together until there are so many


class MergeSortTree:
    """Over values (integers from 0 on) with weights. below(i, v): the weight of points before i with values under v, for arrays i and v."""

    def __init__(self, values: np.ndarray, weights: np.ndarray):
        n = len(values)
        self.depth = max(1, int(n - 1).bit_length()) if n > 1 else 1
        size = 1 << self.depth
        top = int(values.max(initial=0)) + 1
        v = np.concatenate([values, np.full(size - n, top, np.int64)])  # what fills up is never under a value that is asked for
        w = np.concatenate([weights, np.zeros(size - n, np.int64)])
        order = np.arange(size)
        order = order[np.argsort(v, kind="stable")]
        self.root = v[order]
        self.left: list[np.ndarray] = []  # by level, from the root on: before each place, how many went left
        self.sums: list[np.ndarray] = []  # and, of the level below, the weights before each place
        for level in range(self.depth - 1, -1, -1):
            right = (order >> level & 1).astype(bool)
            self.left.append(np.concatenate([[0], np.cumsum(~right)]).astype(np.int32))
            # stable: children keep the order by value, and stand at the places of their points
            order = order[np.argsort(order >> level, kind="stable")]
            self.sums.append(np.concatenate([[0], np.cumsum(w[order])]))
        self.size, self.total = n, np.concatenate([[0], np.cumsum(w[np.argsort(v, kind="stable")])])

    def below(self, i: np.ndarray, v: np.ndarray) -> np.ndarray:
        place = np.searchsorted(self.root, v, "left")
        start, out = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        whole = i >= 1 << self.depth  # all points are before it
        for k, level in enumerate(range(self.depth - 1, -1, -1)):
            went = self.left[k][start + place] - self.left[k][start]
            right = (i >> level & 1).astype(bool) & ~whole
            out += np.where(right, self.sums[k][start + went] - self.sums[k][start], 0)
            start = np.where(right, start + (1 << level), start)
            place = np.where(right, place - went, went)
        return np.where(whole, self.total[np.searchsorted(self.root, v, "left")], out)

    def between(self, lo: np.ndarray, hi: np.ndarray, v: np.ndarray) -> np.ndarray:
        return self.below(hi, v) - self.below(lo, v)

    def ranked(self, lo: np.ndarray, hi: np.ndarray, rank: np.ndarray, top: int) -> np.ndarray:
        """The least value under top with rank points or more up to it, between lo and hi, by weight; top where there is none."""
        low, high = np.zeros(len(lo), np.int64), np.full(len(lo), top, np.int64)
        while (low < high).any():
            mid = (low + high) // 2
            enough = self.between(lo, hi, mid + 1) >= rank
            high, low = np.where(enough & (low < high), mid, high), np.where(~enough & (low < high), mid + 1, low)
        return low


def _whole_groups(batches: Iterator[pa.RecordBatch], key: Sequence[str]) -> Iterator[pa.Table]:
    """Tables of whole groups of equal key, of sorted batches, with TOGETHER rows about, or one group."""
    held: list[pa.RecordBatch] = []
    rows, last = 0, None
    for batch in batches:
        if not len(batch):
            continue
        first = np.zeros(len(batch), bool)
        for c in key:
            x = batch.column(c).to_numpy(zero_copy_only=False)
            first[1:] |= x[1:] != x[:-1]
        now = [batch.column(c)[0].as_py() for c in key]
        first[0] = last is not None and now != last
        cuts = np.flatnonzero(first)
        if len(cuts) and rows + int(cuts[-1]) >= TOGETHER:
            cut = int(cuts[-1])
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held, rows = [], 0
            batch = batch.slice(cut)
        held.append(batch)
        rows += len(batch)
        last = [batch.column(c)[len(batch) - 1].as_py() for c in key]
    if held:
        yield pa.Table.from_batches(held)


def _answers(t: pa.Table, windows: Sequence[int], shares: Sequence[tuple[int, int]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """For each question of whole cells, and each window, what it holds. Rows are sorted by group, cell and time."""
    get = lambda c, null=0: t.column(c).combine_chunks().fill_null(null).to_numpy(zero_copy_only=False)
    group, cell, time, weight, kind = get("key_hash"), get("cell"), get("time"), get("weight"), get("kind")
    asks = weight == 0
    known = t.column("value").is_valid().to_numpy()
    value = get("value")
    new = np.ones(len(group), bool)
    new[1:] = (group[1:] != group[:-1]) | (cell[1:] != cell[:-1])
    number = np.cumsum(new) - 1  # of the cell
    p = np.flatnonzero(~asks)
    levels, rank = np.unique(value[p][known[p]], return_inverse=True)
    rank_all = np.full(len(p), len(levels), np.int64)  # without a value: above all
    rank_all[known[p]] = rank
    by_value = MergeSortTree(rank_all, weight[p])
    # the last point of the same cell and kind before each; points without a kind never count
    kinds = t.column("kind").is_valid().to_numpy()[p]
    order = np.lexsort((np.arange(len(p)), kind[p], number[p]))
    before = np.zeros(len(p), np.int64)  # 0: none, else its place and 1
    same = (number[p][order][1:] == number[p][order][:-1]) & (kind[p][order][1:] == kind[p][order][:-1]) & kinds[order][1:] & kinds[order][:-1]
    before[order[1:][same]] = order[:-1][same] + 1
    before[~kinds] = len(p) + 1
    by_last = MergeSortTree(before, np.ones(len(p), np.int64))
    events, counted = np.concatenate([[0], np.cumsum(weight[p])]), np.concatenate([[0], np.cumsum(np.where(known[p], weight[p], 0))])
    sums = np.concatenate([[0], np.cumsum(np.where(known[p], weight[p] * value[p], 0))])
    q = np.flatnonzero(asks)
    if not len(q):
        return
    # places of times among the points, in one order over cells
    low = int(time.min())
    step = int(time.max()) - low + max(windows) + 2
    flat = lambda n, at: n * step + np.maximum(at - low, -1) + 1
    points = flat(number[p], time[p])
    for w in windows:
        lo = np.searchsorted(points, flat(number[q], time[q] - w), "left")
        hi = np.searchsorted(points, flat(number[q], time[q]), "left")
        m = counted[hi] - counted[lo]
        out = [pa.array(x) for x in (group[q], time[q], np.full(len(q), w, np.int64), events[hi] - events[lo], sums[hi] - sums[lo], by_last.between(lo, hi, lo + 1))]
        for top, bottom in shares:
            at = by_value.ranked(lo, hi, -(-top * m // bottom), len(levels))
            out.append(pa.array(np.append(levels, 0)[at], mask=m == 0))
        yield pa.RecordBatch.from_arrays(out, names=names)


def window_features(df: DataFrame, key: Column, time: Column, value: Column, kind: Column, windows: Sequence[int], shares: Sequence[tuple[str, int, int]]) -> DataFrame:
    """df and window_s, n_events, sum_value, n_kinds and the named ranks, in one row for each row of df and window.

    The window W of a row holds the rows of its key (null is a key) with
    time - W <= their time < time: not the row itself, nor others of its time. key is a string,
    time whole seconds; value an integer or null, kind a string or null. shares names
    (name, a, b): the value number ceil(a * m / b), from 1, of the m values of a window in rising order, repeats
    kept; null without values. sum_value is 0 then. Rows with a null time are in no window and have none: their
    numbers are null. Repeated rows count as often as they occur. An empty table gives an empty one.
    """
    longest, cell = max(windows), max(1, max(windows) // CELLS)
    hashed = F.xxhash64(key, key.isNull())
    rows = df.withColumns({"_key": hashed, "_time": time.cast("long")})
    points = df.select(hashed.alias("key_hash"), time.cast("long").alias("time"), value.cast("long").alias("value"), F.when(kind.isNotNull(), F.xxhash64(kind)).alias("kind")).where("time IS NOT NULL")
    points = points.groupBy("key_hash", "time", "value", "kind").agg(F.count("*").alias("weight"))
    reach = F.sequence(F.floor((F.col("time") + 1) / cell), F.floor((F.col("time") + longest) / cell))
    dealt = points.select("key_hash", F.explode(reach).alias("cell"), "time", "value", "kind", "weight")
    asked = rows.where("_time IS NOT NULL").select(F.col("_key").alias("key_hash"), F.col("_time").alias("time")).distinct()
    none = F.lit(None).cast("long")
    questions = asked.select("key_hash", F.floor(F.col("time") / cell).alias("cell"), "time", none.alias("value"), none.alias("kind"), F.lit(0).cast("long").alias("weight"))
    names = ["_key", "_time", "window_s", "n_events", "sum_value", "n_kinds", *[n for n, _, _ in shares]]
    schema = ", ".join(f"{n} long" for n in names)
    ratios = [(a, b) for _, a, b in shares]

    def answer(batches):
        for t in _whole_groups(batches, ["key_hash", "cell"]):
            yield from _answers(t, windows, ratios, names)

    found = dealt.unionByName(questions).repartition("key_hash", "cell").sortWithinPartitions("key_hash", "cell", "time").mapInArrow(answer, schema)
    timed = rows.where("_time IS NOT NULL").join(found, ["_key", "_time"])
    bare = rows.where("_time IS NULL").withColumn("window_s", F.explode(F.array(*[F.lit(w).cast("long") for w in windows])))
    return timed.unionByName(bare, allowMissingColumns=True).drop("_key", "_time")


def rolling_window_features(docs: DataFrame, windows: Sequence[int] = (600, 43200)) -> DataFrame:
    """doc_id, window_s, event_s, n_events, sum_chars, n_langs, median_chars, high_chars: two rows for each row of documents.

    The time of a row follows from its id: 60 * floor((doc_id + (crc32 mod 10000)) / 6). A row with a null id has no time: it
    is in no window, and its numbers are null. Lengths are code points of the whole text; null text has none.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.length(F.col("text").cast("string")).alias("chars"))
    tenths = F.col("doc_id") + F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10000
    narrow = narrow.withColumn("tenths", tenths).withColumn("event_s", F.expr("60 * ((tenths - pmod(tenths, 6)) div 6)")).drop("tenths")
    out = window_features(narrow, F.col("source"), F.col("event_s"), F.col("chars"), F.col("lang"), windows, (("median_chars", 1, 2), ("high_chars", 90, 100)))
    return out.select("doc_id", "window_s", "event_s", "n_events", F.col("sum_value").alias("sum_chars"), F.col("n_kinds").alias("n_langs"), "median_chars", "high_chars")
