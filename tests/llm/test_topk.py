import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.llm import topk as T


def plain(rows, k, scale=1024):
    v = {}
    for i, x in rows:
        if i is not None and x is not None and all(y is not None and math.isfinite(y) for y in x):
            v.setdefault(i, set()).add(tuple(math.floor(scale * y) for y in x))
    out = []
    for q in v:
        if q % 5 == 0:
            best = {c: max(sum(a * b for a, b in zip(x, y, strict=False)) for x in v[q] for y in v[c]) for c in v if c != q}
            out += [(q, n, c, s) for n, (c, s) in enumerate(sorted(best.items(), key=lambda z: (-z[1], z[0]))[:k], 1)]
    return sorted(out)


def result(spark, rows, k, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS ring", "2 AS dist", "3 AS rank").repartition(3)
    return sorted(map(tuple, T.exact_top_k(df, F.col("vec_id") % 5 == 0, k, **more).collect()))


@pytest.fixture
def small(monkeypatch):
    for name, value in {"SAMPLE": 40, "PIVOTS": 6, "RINGS": 4, "PER_PIVOT": 20, "BLOCK": 16, "QUERIES": 8, "SLICE_BYTES": 700}.items():
        monkeypatch.setattr(T, name, value)


def test_results_are_those_of_all_products(spark, small):
    r = np.random.default_rng(0)
    centres = r.normal(size=(8, 6))
    rows = [(i, (centres[i % 8] + 0.3 * r.normal(size=6)).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(80)]  # one vector many times
    rows += [rows[5], rows[10], (10, rows[3][1]), (11, rows[4][1]), (2000, None), (2005, [1.0, None]), (2010, [float("nan")]), (2015, [float("inf"), 1.0]), (None, [1.0]), (2020, []), (2025, [9.0, 1.0]), (2030, [0.0] * 6)]
    random.Random(1).shuffle(rows)
    assert result(spark, rows, 7) == plain(rows, 7)


def test_few_rows_ties_and_large_numbers(spark, small):
    assert result(spark, [(0, [1.0]), (5, [2.0]), (7, [2.0])], 10) == plain([(0, [1.0]), (5, [2.0]), (7, [2.0])], 10)
    big = [(i, [(-1.0) ** i * (1e4 + i), float(i * i)]) for i in range(60)]
    assert result(spark, big, 3, scale=1 << 16) == plain(big, 3, 1 << 16)
    assert result(spark, [], 3) == [] and result(spark, [(1, [1.0])], 3) == [] and result(spark, [(5, [1.0])], 3) == [] and result(spark, [(0, None), (5, None)], 3) == []
    rows = [(0, [1.0, 2.0]), (1, [1.0, 0.0]), (2, [1e18, 0.0]), (3, [1e308, 1e308]), (5, [3.0, 1.0])]
    assert result(spark, rows, 3) == plain([x for x in rows if x[0] not in (2, 3)], 3)  # products of these are no 64-bit integers


def test_queries_move_and_vectors_stay():
    sizes = {(0, 0): 10, (0, 1): 3, (0, 2): 4, (1, 0): 50, (1, 1): 2, (2, 0): 12}
    got = T._slices(sizes, 12)
    assert got == {(0, 0): (0, 1), (0, 1): (1, 1), (0, 2): (1, 1), (1, 0): (2, 5), (1, 1): (7, 1), (2, 0): (8, 1)}
    held = {}
    for ring, (first, parts) in got.items():
        for n in range(first, first + parts):
            held[n] = held.get(n, 0) + sizes[ring] / parts
    assert sorted(held) == list(range(9)) and max(held.values()) <= 12


def test_rings_are_skipped_where_bounds_allow():
    x = np.array([[1000.0, 0.0], [0.0, 1000.0], [-1000.0, 0.0]])
    index = T.Index(1, 2, 1e6, x[:1], np.zeros(1), np.empty(0, np.int64), np.empty((0, 2), np.int64), "<i8")
    d = index.distances(x[:1], lifted=False)[:, 0]
    near, far = index.highest(np.array([1e6]), d, 0.0, 10.0), index.highest(np.array([1e6]), d, 1900.0, 2000.0)
    assert near[0] >= 1e6 and far[0] < 0


def test_rings_of_the_real_table_are_skipped_and_the_sample_is_a_part_of_it(spark, monkeypatch):
    """The index that the query builds over sf0.01: 16 pivots, a sample of less than half the table, and rings that queries pass over."""
    seen = {}
    send = spark.sparkContext.broadcast

    def kept(self, x):
        if isinstance(x, T.Index):
            seen["index"] = x
        return send(x)

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", kept)
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = T.exact_top_k(vectors, F.col("vec_id") % 100 == 0).collect()
    index, n = seen["index"], vectors.count()
    assert len(index.pivots) == 16 and len(index.sample) < n / 2 and len(got) == 10 * vectors.where("vec_id % 100 = 0").count()
    queries = [r.embedding for r in vectors.where("vec_id % 100 = 0").orderBy("vec_id").collect()]
    q = np.floor(1024 * np.array(queries))
    least = np.array([s for _, s in sorted((r.query_id, r.score) for r in got if r["rank"] == 10)], float)
    d, squares = index.distances(q, lifted=False), (q**2).sum(axis=1)
    skipped = sum(int((index.highest(squares, d[:, pivot], lo, hi) < least).sum()) for (pivot, _), (lo, hi) in index.rings.items())
    assert skipped > 0.1 * len(q) * len(index.rings)
