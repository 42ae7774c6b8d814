"""Exact top-k inner products over a pivot-distance index.

Integer vectors x gain a coordinate sqrt(M^2 - |x|^2), M the largest norm, and
queries gain 0; the inner product then falls as the distance grows, so nearest
neighbours are highest scores. Every vector is keyed by its nearest pivot and
its distance to it, in rings. For a query at distance d of a pivot, no vector
of an annulus [lo, hi] is nearer than max(lo - d, d - hi, 0). Rings are expanded
from the best bound on, and inside a ring its vectors, sorted by distance, in
narrower annuli; a query stops where the bound cannot reach its k-th score.
Scores are integers throughout; only bounds are floating point, with room for rounding.

Pivots, 16 or more, are chosen from a bounded sample, a small part of any but the smallest table, that is also the first source of
thresholds; pivots times rings are at most PIVOTS * RINGS, so the bounds of all
rings fit a broadcast. Vectors move once, into slices of whole rings or of parts
of one, of bounded size whatever a pivot or ring gathers; a task holds a slice.
Queries, in blocks, go to the slices whose rings may serve them, and only scores
that may be among the k highest come back. So what moves is the vectors, once,
and the queries times the slices they may need.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import durable

SAMPLE = 2048  # rows at most; of few rows, about k times the square root of their number
LEAST = 16  # pivots, if the sample has so many different vectors
PIVOTS = 64
RINGS = 16
PER_PIVOT = 4096  # vectors for which one more pivot is made, until there are PIVOTS
BLOCK = 4096  # vectors in an annulus inside a ring
QUERIES = 1024  # queries in a block
SLICE_BYTES = 32 << 20  # of vectors in a slice, about

_KEYED = "vec_id long, is_query boolean, pivot int, ring int, dist double, vec binary"
_STATS = "n long, queries long, dim int, top double, square double"
_WORK = "slice int, kind int, pivot int, ring int, vec_id long, dist double, block long, ids binary, vectors binary"
_RESULT = "query_id long, vec_id long, score long"


def _integers(column: pa.Array, scale: int, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of floor(scale * x), shorter ones filled with zeros, and which rows take part; those that do not are zeros.

    A row whose product with itself is no 64-bit integer takes no part.
    """
    n = len(column)
    if not n:
        return np.zeros((0, dim or 0)), np.zeros(0, bool)
    at = column.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)[at[0] : at[-1]]  # null becomes NaN
    at = at - at[0]
    bad = np.append(0, np.cumsum(~np.isfinite(values)))
    ok = column.is_valid().to_numpy(zero_copy_only=False) & (bad[at[1:]] == bad[at[:-1]])
    size = np.where(ok, np.diff(at), 0)
    out = np.zeros((n, dim if dim is not None else int(size.max(initial=0))))
    row = np.repeat(np.arange(n), size)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    with np.errstate(over="ignore", invalid="ignore"):
        out[row, nth] = np.floor(scale * values[np.repeat(at[:-1], size) + nth])
        small = (out**2).sum(axis=1) < 2.0**62
    out[~small] = 0
    return out, ok & small


def _products(a: np.ndarray, b: np.ndarray, square: float) -> np.ndarray:
    """Integer products of rows whose squared norms are square at most; through floating point where that is exact."""
    kind = np.float32 if square < 2.0**24 else np.float64 if square < 2.0**52 else np.int64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


@dataclass
class Index:
    """What every task knows: size-bounded, whatever the input."""

    scale: int
    dim: int
    square: float  # M^2
    pivots: np.ndarray
    lift: np.ndarray  # last coordinate of each pivot
    sample_ids: np.ndarray
    sample: np.ndarray
    width: str  # of a component
    rings: dict[tuple[int, int], tuple[float, float]] | None = None
    slices: dict[tuple[int, int], tuple[int, int]] | None = None  # the first slice of a ring, and how many it has

    @property
    def slack(self) -> float:
        return 1e-6 * (1 + np.sqrt(self.square))

    def distances(self, x: np.ndarray, lifted: bool) -> np.ndarray:
        """To each pivot, of vectors (lifted) or of queries."""
        square = (x**2).sum(axis=1)
        up = np.sqrt(np.maximum(self.square - square, 0)) if lifted else np.zeros(len(x))
        d = square[:, None] + up[:, None] ** 2 + self.square - 2 * (x @ self.pivots.T) - 2 * up[:, None] * self.lift[None, :]
        return np.sqrt(np.maximum(d, 0))

    def highest(self, square: np.ndarray, d: np.ndarray, lo: float, hi: float) -> np.ndarray:
        """The score that no vector of a ring exceeds, for queries with squared norms and distances d to its pivot."""
        nearest = np.maximum(np.maximum(lo - d, d - hi) - self.slack, 0)
        return (square + self.square - nearest**2) / 2 + 1e-9 * self.square + 1


def _far_apart(x: np.ndarray, n: int) -> np.ndarray:
    """Indices of n rows, each the farthest from those before."""
    chosen = [0]
    d = ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < n and d.max() > 0:
        chosen.append(int(d.argmax()))
        d = np.minimum(d, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return np.array(chosen)


class _Best:
    """The k best (score, then smaller id) of each query so far."""

    def __init__(self, ids: np.ndarray, k: int):
        self.k, self.own = k, ids
        self.score = [np.empty(0, np.int64)] * len(ids)
        self.ids = [np.empty(0, np.int64)] * len(ids)
        self.least = np.full(len(ids), -np.inf)  # of the k-th; ties may still come in

    def add(self, q: int, ids: np.ndarray, score: np.ndarray) -> None:
        take = (score >= self.least[q]) & (ids != self.own[q])
        if not take.any():
            return
        score, ids = np.concatenate([self.score[q], score[take]]), np.concatenate([self.ids[q], ids[take]])
        order = np.lexsort((ids, -score))
        _, first = np.unique(ids[order], return_index=True)
        order = order[np.sort(first)][: self.k]
        self.score[q], self.ids[q] = score[order], ids[order]
        if len(order) == self.k:
            last = int(score[order][-1])
            self.least[q] = max(self.least[q], float(last) if abs(last) < 2**52 else np.nextafter(float(last), -np.inf))


def _once(ids: np.ndarray, x: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each (id, vector) once, by id."""
    order = np.lexsort((*x.T[::-1], ids)) if len(ids) else np.empty(0, np.int64)
    ids, x = ids[order], x[order]
    keep = np.ones(len(ids), bool)
    keep[1:] = (ids[1:] != ids[:-1]) | (x[1:] != x[:-1]).any(axis=1)
    return np.ascontiguousarray(ids[keep]), np.ascontiguousarray(x[keep]), *(m[order][keep] for m in more)


def _packed(batches, index: Index, group: tuple[str, ...], most: int):
    """Rows sorted by group become blocks of at most most vectors: ids and vectors as bytes."""
    held: list[pa.RecordBatch] = []

    def block(rows):
        t = pa.Table.from_batches(rows)
        ids, x = _once(t.column("vec_id").to_numpy(), np.frombuffer(b"".join(t.column("vec").to_pylist()), index.width).reshape(len(t), index.dim))
        return pa.RecordBatch.from_arrays([*(t.column(g).combine_chunks()[:1] if isinstance(t.column(g).combine_chunks(), pa.Array) else t.column(g).chunk(0)[:1] for g in group), pa.array([ids.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=[*group, "ids", "vectors"])

    at = None
    for batch in batches:
        keys = list(zip(*(batch.column(g).to_pylist() for g in group), strict=True))
        low = 0
        while low < len(keys):
            high = low
            while high < len(keys) and keys[high] == keys[low]:
                high += 1
            if keys[low] != at and held:
                yield block(held)
                held = []
            at = keys[low]
            held.append(batch.slice(low, high - low))
            if sum(map(len, held)) >= most:
                yield block(held)
                held = []
            low = high
    if held:
        yield block(held)


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k other vectors with the highest inner products of floor(scale * x).

    Ties go to the smaller id; with fewer than k others, all are given. Rows with
    a null id, a null vector, or a null or non-finite component take no part.
    Shorter vectors count as filled with zeros. A repeated row counts once; an id
    with several vectors is one candidate and one query, by its best product.
    No rows, or no queries, give none. A vector whose product with itself is no
    64-bit integer takes no part. Other columns are not read.
    """
    spark = vectors.sparkSession
    narrow = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query")).where("vec_id IS NOT NULL AND v IS NOT NULL")

    def measure(batches):
        n = queries = dim = 0
        top = square = 0.0
        for batch in batches:
            x, ok = _integers(batch.column("v"), scale)
            x = x[ok]
            n += len(x)
            queries += int((ok & batch.column("is_query").to_numpy(zero_copy_only=False)).sum())
            if x.size:
                dim = max(dim, x.shape[1])
                top = max(top, float(np.abs(x).max()))
                square = max(square, float((x**2).sum(axis=1).max()))
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([queries], pa.int64()), pa.array([dim], pa.int32()), pa.array([top]), pa.array([square])], names=["n", "queries", "dim", "top", "square"])

    total, queries, dim, top, square = narrow.mapInArrow(measure, _STATS).agg(F.sum("n"), F.sum("queries"), F.max("dim"), F.max("top"), F.max("square")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not total or not queries:
        return empty
    # a bounded sample of all rows: those with the smallest hashes; some four times as many are ranked, whatever the total
    h, drawn = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40)), min(SAMPLE, max(4 * LEAST, k * math.isqrt(total)))
    rows = narrow.where(h < min(1 << 40, -(-4 * drawn * (1 << 40) // total))).orderBy(h, "vec_id").limit(drawn).collect()
    x, ok = _integers(pa.array([r.v for r in rows], pa.list_(pa.float64())), scale, dim)
    ids = np.array([r.vec_id for r in rows], np.int64)
    x, ids = (x[ok], ids[ok]) if ok.any() else (np.zeros((1, dim)), np.array([0], np.int64))
    real = ok.any()
    lift = np.sqrt(np.maximum(square - (x**2).sum(axis=1), 0))
    chosen = _far_apart(np.concatenate([x, lift[:, None]], axis=1), min(PIVOTS, max(LEAST, total // PER_PIVOT)))
    index = Index(scale, dim, square, x[chosen], lift[chosen], ids if real else ids[:0], (x if real else x[:0]).astype(np.int64), "<i2" if top < 2**15 else "<i4" if top < 2**31 else "<i8")
    sent = spark.sparkContext.broadcast(index)
    width = 2 * np.sqrt(square) / RINGS + 1e-9

    def place(batches):
        i = sent.value
        for batch in batches:
            x, ok = _integers(batch.column("v"), i.scale, i.dim)
            x = x[ok]
            kept = batch.filter(pa.array(ok))
            d = i.distances(x, lifted=True)
            pivot = d.argmin(axis=1)
            near = d[np.arange(len(x)), pivot]
            raw = np.ascontiguousarray(x.astype(i.width))
            yield pa.RecordBatch.from_arrays(
                [kept.column("vec_id"), kept.column("is_query"), pa.array(pivot.astype(np.int32)), pa.array(np.minimum(near / width, RINGS - 1).astype(np.int32)), pa.array(near), pa.array([r.tobytes() for r in raw], pa.binary())],
                names=["vec_id", "is_query", "pivot", "ring", "dist", "vec"],
            )

    keyed = durable(narrow.mapInArrow(place, _KEYED))
    # at most PIVOTS * RINGS rows
    rings = {(r.pivot, r.ring): (r.lo, r.hi, r.n, r.q) for r in keyed.groupBy("pivot", "ring").agg(F.min("dist").alias("lo"), F.max("dist").alias("hi"), F.count("*").alias("n"), F.count_if("is_query").alias("q")).collect()}
    index.rings = {at: (lo, hi) for at, (lo, hi, _, _) in rings.items()}
    index.slices = _slices({at: n for at, (_, _, n, _) in rings.items()}, _vectors_of_a_slice(spark, total, dim * np.dtype(index.width).itemsize + 16))
    sent = spark.sparkContext.broadcast(index)
    place_of = spark.createDataFrame([(*at, first, parts) for at, (first, parts) in index.slices.items()], "pivot int, ring int, first int, parts int")
    none = lambda kind: F.lit(None).cast(kind)
    held = keyed.join(F.broadcast(place_of), ["pivot", "ring"]).select((F.col("first") + F.pmod(F.xxhash64("vec_id"), "parts")).cast("int").alias("slice"), F.lit(0).alias("kind"), "pivot", "ring", "vec_id", "dist", none("long").alias("block"), none("binary").alias("ids"), F.col("vec").alias("vectors"))

    # queries of one pivot share blocks; those of pivots with few queries are pooled
    per = {}
    for (pivot, _), (_, _, _, q) in rings.items():
        per[pivot] = per.get(pivot, 0) + q
    pooled = sum(q for q in per.values() if q < QUERIES)
    home = spark.createDataFrame([(p, p if q >= QUERIES else -1, max(1, -(-2 * (q if q >= QUERIES else pooled) // QUERIES) if (q >= QUERIES or pooled > QUERIES) else 1)) for p, q in per.items()], "pivot int, pool int, pools int")
    asked = keyed.where("is_query").join(F.broadcast(home), "pivot").withColumn("part", F.pmod(F.xxhash64(F.lit(3), F.col("vec_id")), "pools").cast("int"))
    asked = asked.select("pool", "part", "vec_id", "vec").repartition("pool", "part").sortWithinPartitions("pool", "part").mapInArrow(lambda b: _packed(b, sent.value, ("pool", "part"), QUERIES), "pool int, part int, ids binary, vectors binary")
    asked = durable(asked.withColumn("block", F.xxhash64("pool", "part", "ids")))

    def reach(batches):
        """A block of queries for each slice of the rings that may serve it; thresholds come from the sample."""
        i = sent.value
        for batch in batches:
            for block, qids, raw in zip(*(batch.column(c).to_pylist() for c in ("block", "ids", "vectors")), strict=True):
                _, least, d, squares = _queries(i, qids, raw, k)
                wanted = set()
                for (pivot, ring), (lo, hi) in i.rings.items():
                    if (i.highest(squares, d[:, pivot], lo, hi) >= least).any():
                        first, parts = i.slices[pivot, ring]
                        wanted.update(range(first, first + parts))
                for at in sorted(wanted):  # a row at a time: a block may be wanted in every slice
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([at], pa.int32()), pa.array([1], pa.int32()), *(pa.array([None], t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.float64())), pa.array([block], pa.int64()), pa.array([qids], pa.binary()), pa.array([raw], pa.binary())],
                        names=[x.split()[0] for x in _WORK.split(", ")],
                    )

    def expand(batches):
        i, at, rows, annuli = sent.value, None, [], None
        for batch in batches:
            slices, kinds = batch.column("slice").to_numpy(), batch.column("kind").to_numpy()
            edge = np.append(np.flatnonzero((np.diff(slices) != 0) | (np.diff(kinds) != 0)) + 1, len(batch)) if len(batch) else []
            low = 0
            for high in edge:
                part, low = batch.slice(low, high - low), int(high)
                here = part.column("slice")[0].as_py()
                if here != at:
                    at, rows, annuli = here, [], None
                if part.column("kind")[0].as_py() == 0:
                    rows.append(_block(part, i))
                    continue
                if annuli is None:  # all vectors of the slice came before its queries
                    annuli, rows = _annuli(rows), []
                for ids, raw in zip(part.column("ids").to_pylist(), part.column("vectors").to_pylist(), strict=True):
                    yield _expanded(i, annuli, ids, raw, k)

    work = held.unionByName(asked.mapInArrow(reach, _WORK))
    found = work.repartition("slice").sortWithinPartitions("slice", "kind", "pivot", "ring").mapInArrow(expand, _RESULT)
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _queries(i: Index, ids: bytes, raw: bytes, k: int):
    """Vectors, lowest score worth having (the k-th in the sample), distances to pivots, squared norms."""
    q = np.frombuffer(raw, i.width).reshape(-1, i.dim)
    own = np.frombuffer(ids, np.int64)
    least = np.full(len(q), -np.inf)
    distinct = np.unique(i.sample_ids, return_index=True)[1]
    if len(distinct) > k:
        score = _products(q, i.sample[distinct], i.square).astype(np.float64)
        score[own[:, None] == i.sample_ids[distinct][None, :]] = -np.inf
        least = np.partition(score, -k, axis=1)[:, -k]
        least = np.where(np.abs(least) < 2.0**52, least, -np.inf)
    x = q.astype(np.float64)
    return q, least, i.distances(x, lifted=False), (x**2).sum(axis=1)


def _vectors_of_a_slice(spark, total: int, each: int) -> int:
    """As many as SLICE_BYTES hold, but so few that all cores have work; BLOCK at least."""
    return max(BLOCK, min(SLICE_BYTES // each, -(-total // (4 * spark.sparkContext.defaultParallelism))))


def _slices(sizes: dict[tuple[int, int], int], most: int) -> dict[tuple[int, int], tuple[int, int]]:
    """First slice and number of slices of each ring: small rings that follow each other share one, large ones have several."""
    out, at, room = {}, 0, most
    for ring in sorted(sizes):
        n = sizes[ring]
        if n > room and room < most:
            at, room = at + 1, most
        parts = max(1, -(-n // most))
        out[ring] = (at, parts)
        if parts > 1:
            at, room = at + parts, most
        else:
            room -= n
    return out


def _block(batch: pa.RecordBatch, i: Index) -> tuple[np.ndarray, ...]:
    """Ids, vectors, distances, pivots and rings of rows."""
    raw = np.frombuffer(b"".join(batch.column("vectors").to_pylist()), i.width).reshape(len(batch), i.dim)
    return batch.column("vec_id").to_numpy(), raw, *(batch.column(c).to_numpy() for c in ("dist", "pivot", "ring"))


def _annuli(rows: list[tuple[np.ndarray, ...]]) -> list[tuple[int, float, float, np.ndarray, np.ndarray]]:
    """Pivot, least and largest distance, ids and vectors of annuli of BLOCK vectors at most, each inside a ring. A repeated row counts once."""
    if not rows:
        return []
    ids, x, dist, pivot, ring = _once(*(np.concatenate(c) for c in zip(*rows, strict=True)))
    order = np.lexsort((dist, ring, pivot))
    ids, x, dist, pivot, ring = (c[order] for c in (ids, x, dist, pivot, ring))
    new = np.flatnonzero(np.append(True, (pivot[1:] != pivot[:-1]) | (ring[1:] != ring[:-1])))
    out = []
    for a, b in zip(new, np.append(new[1:], len(ids)), strict=True):
        for low in range(a, b, BLOCK):
            high = min(low + BLOCK, b)
            out.append((int(pivot[low]), float(dist[low]), float(dist[high - 1]), ids[low:high], x[low:high]))
    return out


def _expanded(i: Index, annuli: list, ids: bytes, raw: bytes, k: int) -> pa.RecordBatch:
    """The best candidates of a slice for a block of queries, annuli with the best bound first."""
    q, least, d, squares = _queries(i, ids, raw, k)
    best = _Best(np.frombuffer(ids, np.int64), k)
    best.least = least.copy()
    tops = [i.highest(squares, d[:, pivot], lo, hi) for pivot, lo, hi, _, _ in annuli]
    for n in sorted(range(len(annuli)), key=lambda n: -tops[n].max(initial=-np.inf)):
        live = np.flatnonzero(tops[n] >= best.least)
        if not len(live):
            continue
        _, _, _, other, x = annuli[n]
        score = _products(q[live], x, i.square)
        reach = score >= best.least[live][:, None]
        for m in np.flatnonzero(reach.any(axis=1)):
            best.add(int(live[m]), other[reach[m]], score[m][reach[m]])
    return _answers(best)


def _answers(best: _Best) -> pa.RecordBatch:
    n = [len(s) for s in best.score]
    join = lambda parts: np.concatenate([*parts, np.empty(0, np.int64)]).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(best.own, n)), pa.array(join(best.ids)), pa.array(join(best.score))], names=["query_id", "vec_id", "score"])
