"""Product codes of integer vectors, with a ball tree for each part's codebook.

Components become floor(scale * x). Every part position has its own codebook,
which starts as that part of the vectors with the smallest ids and moves by
rounds of exact integer means. The nearest entry of a part is found in a ball
tree over the entries: a node is a centre and a radius, rounded up, and by the
triangle inequality nothing inside is nearer than the distance to the centre
less the radius. Nodes that could hold an entry as near as the best one so far
are visited, ties included, as the lower index wins; distances that decide are
64-bit integers. Bounds alone are floating point, rounded so that they only err
towards a visit.

Trees and codebooks hold parts * entries vectors whatever the input, so they are
sent to all tasks. A round is one pass: each task adds up its vectors by entry,
and only those sums, of a fixed size a task, are shuffled.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .topk import _integers
from .workspace import durable, spread_join

LEAF = 16
_SQUARE = 2.0**58  # squared norms below it: squares of distances stay below 2^60
_BATCH = 4096  # vectors that go down the trees together


@dataclass
class BallTree:
    """Over the rows of entries, integers. nearest() gives the index and the squared distance of the nearest row, ties to the lower index."""

    entries: np.ndarray
    centre: list[np.ndarray] = field(default_factory=list)
    radius: list[float] = field(default_factory=list)
    below: list[tuple[int, int] | None] = field(default_factory=list)
    rows: list[np.ndarray] = field(default_factory=list)
    compared: int = 0  # pairs of a vector and an entry whose distance was taken

    def __post_init__(self):
        self._grow(np.arange(len(self.entries)))

    def _grow(self, rows: np.ndarray) -> int:
        x = self.entries[rows].astype(np.float64)
        at, centre = len(self.centre), x.mean(axis=0)
        self.centre.append(centre)
        self.radius.append(float(np.sqrt(((x - centre) ** 2).sum(axis=1).max())) * (1 + 1e-9) + 1e-6)
        self.below.append(None)
        self.rows.append(np.sort(rows))
        wide = int(np.ptp(x, axis=0).argmax())
        if len(rows) > LEAF and np.ptp(x[:, wide]) > 0:
            order = rows[np.argsort(x[:, wide], kind="stable")]
            half = len(order) // 2
            self.below[at] = (self._grow(order[:half]), self._grow(order[half:]))
        return at

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        index, best = np.full(len(x), len(self.entries), np.int64), np.full(len(x), np.iinfo(np.int64).max, np.int64)
        wide = x.astype(np.float64)

        def away(node: int, some: np.ndarray) -> np.ndarray:
            return np.sqrt(((wide[some] - self.centre[node]) ** 2).sum(axis=1)) * (1 - 1e-9) - self.radius[node]

        def leaf(node: int, some: np.ndarray) -> None:
            rows = self.rows[node]
            self.compared += len(some) * len(rows)
            d = ((x[some][:, None, :] - self.entries[rows][None, :, :]) ** 2).sum(axis=2)
            first = d.argmin(axis=1)  # the lowest index of those as near
            d, first = d[np.arange(len(some)), first], rows[first]
            better = (d < best[some]) | (d == best[some]) & (first < index[some])
            best[some[better]], index[some[better]] = d[better], first[better]

        def visit(node: int, some: np.ndarray) -> None:
            if not len(some):
                return
            if self.below[node] is None:
                leaf(node, some)
                return
            a, b = self.below[node]
            to_a, to_b = away(a, some), away(b, some)
            first = to_a <= to_b
            visit(a, some[first])
            visit(b, some[~first])
            reach = np.sqrt(best[some].astype(np.float64)) * (1 + 1e-9) + 1e-6
            visit(b, some[first & (to_b <= reach)])
            visit(a, some[~first & (to_a <= reach)])

        visit(0, np.arange(len(x)))
        return index, best


def _vectors(column: pa.Array, scale: int, parts: int) -> np.ndarray:
    x, _ = _integers(column, scale)
    return x.astype(np.int64).reshape(len(x), parts, -1)


def _usable(rows: DataFrame, scale: int, parts: int) -> DataFrame:
    """Rows whose vector can be coded: finite, without nulls, in equal parts, with integer squares."""
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.pow(x * scale, F.lit(2.0)))
    return rows.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & (F.size("embedding") % parts == 0)).where(finite).where(square < _SQUARE)


def _assigned(trees: list[BallTree], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry of each vector and part."""
    found = [[t.nearest(x[low : low + _BATCH, p]) for low in range(0, len(x), _BATCH)] for p, t in enumerate(trees)]
    stack = lambda k: np.stack([np.concatenate([f[k] for f in part]) if part else np.empty(0, np.int64) for part in found], axis=1)
    return stack(0), stack(1)


def _moved(kept: DataFrame, books: np.ndarray, scale: int) -> np.ndarray:
    """The codebooks after a round: entries become the floor of the mean of their parts, those without parts stay."""
    parts, entries, width = books.shape
    trees = [BallTree(b) for b in books]
    schema = "part int, entry int, n long, " + ", ".join(f"s{j} long" for j in range(width))

    def add(batches):
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            x = _vectors(batch.column("embedding"), scale, parts)
            index, _ = _assigned(trees, x)
            for p in range(parts):
                np.add.at(sums[p], index[:, p], x[:, p])
                counts[p] += np.bincount(index[:, p], minlength=entries)
        part, entry = np.nonzero(counts)
        columns = [part.astype(np.int32), entry.astype(np.int32), counts[part, entry], *sums[part, entry].T]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=[c.split()[0] for c in schema.split(", ")])

    totals = kept.select("embedding").mapInArrow(add, schema).groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(f"s{j}").alias(f"s{j}") for j in range(width)])
    out = books.copy()
    for r in totals.collect():  # a row for each part and entry
        out[r.part, r.entry] = [r[f"s{j}"] // r.n for j in range(width)]
    return out


def compress_vectors(df: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256 for each row of df whose vector can be coded.

    code has two hexadecimal digits for each part (entries is 256 at most);
    error is the sum of the parts' squared distances, label_error that of all
    rows with the label, null being one. Rows are left out whose vector is null
    or empty, holds null or non-finite components, has another length than that
    of the smallest id or one that parts does not divide, or whose squared norm in
    integers reaches 2^58. With fewer rows than entries, every row is an entry.
    Rows may repeat an id: each is coded, and the smaller vector comes first
    among the first entries; null ids come last. An empty table gives an empty
    result. Other columns are not read.
    """
    if not 1 <= entries <= 256:
        raise ValueError(f"entries must be 1 to 256, as a code has two digits: {entries}")
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("embedding"))
    kept = _usable(rows, scale, parts)
    order = [F.col("vec_id").asc_nulls_last(), F.col("embedding")]
    first = kept.orderBy(*order).first()
    if first is None:
        return kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    kept = kept.where(F.size("embedding") == len(first.embedding))
    seeds = kept.orderBy(*order).limit(entries).collect()
    books = np.floor(scale * np.array([r.embedding for r in seeds])).astype(np.int64).reshape(len(seeds), parts, -1).swapaxes(0, 1)
    for _ in range(rounds):
        books = _moved(kept, books, scale)
    trees = [BallTree(b) for b in books]
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()

    def code(batches):
        for batch in batches:
            index, distance = _assigned(trees, _vectors(batch.column("embedding"), scale, parts))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array([r.tobytes().hex() for r in index.astype(np.uint8)], pa.string()), pa.array(distance.sum(axis=1))],
                names=["vec_id", "label", "code", "error"],
            )

    coded = durable(kept.mapInArrow(code, f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, code string, error long"))  # read by the sums and the join
    # labels may be few or many, and one may have a third of all rows
    keyed = coded.withColumns({"_none": F.col("label").isNull(), "_own": F.coalesce(F.col("label").cast("string"), F.lit(""))})
    sums = keyed.groupBy("_none", "_own").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    joined = spread_join(keyed, sums.drop("n"), ["_none", "_own"], sums.select("_none", "_own", "n"), part=["vec_id", "code", "error"])
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
