import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from quadrille.llm import rolling
from quadrille.llm.queries import QUERIES

from .conftest import SF


def plain(rows, windows=(600, 43200)):
    """rows: (doc_id, text, lang, source)."""
    at = [None if i is None else 60 * ((i + zlib.crc32(str(i).encode()) % 10000) // 6) for i, *_ in rows]
    out = []
    for (i, _, _, source), t in zip(rows, at, strict=True):
        for w in windows:
            if t is None:
                out.append((None, w, None, None, None, None, None, None))
                continue
            inside = [r for r, u in zip(rows, at, strict=True) if r[3] == source and u is not None and t - w <= u < t]
            n = sorted(len(r[1]) for r in inside if r[1] is not None)
            m = len(n)
            out.append((i, w, t, len(inside), sum(n), len({r[2] for r in inside} - {None}), n[-(-m // 2) - 1] if m else None, n[-(-90 * m // 100) - 1] if m else None))
    return sorted(map(repr, out))


def result(df):
    return sorted(repr((r.doc_id, r.window_s, r.event_s, r.n_events, r.sum_chars, r.n_langs, r.median_chars, r.high_chars)) for r in df.collect())


def make(spark, rows):
    return spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, lang string, source string, n_events long")


def test_equals_brute_force(spark):
    r = random.Random(2)
    rows = [(i if i % 50 else -i, None if i % 11 == 0 else "ü" * r.choice([0, 1, 5, 5, 5, r.randrange(3000)]), r.choice(["en", "fr", None, ""]), r.choice(["a", "a", "a", "b", None, ""])) for i in range(1200)]
    rows += rows[5:40] + [(None, "x", "en", "a"), (None, None, None, None), (1 << 40, "far", "en", "a")]
    assert result(rolling.rolling_window_features(make(spark, rows).repartition(6))) == plain(rows)
    assert result(rolling.rolling_window_features(make(spark, []))) == []


def test_one_time_of_one_source(spark):
    """Windows end before the row's own time, and equal rows count as often as they occur."""
    rows = [(7, "abc", "en", None)] * 300
    assert result(rolling.rolling_window_features(make(spark, rows))) == plain(rows)


def test_the_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    assert result(QUERIES["op12_rolling_window_features"](spark, SF)) == plain(rows)


def test_other_columns_windows_and_a_null_time(spark):
    df = spark.createDataFrame([("k", 10, 4, "x"), ("k", 11, 9, "y"), ("k", 12, None, "x"), (None, 12, 5, None), ("k", None, 1, "x")], "a string, t long, v long, b string")
    out = rolling.window_features(df, F.col("a"), F.col("t"), F.col("v"), F.col("b"), [1, 2], [("least", 1, 1000), ("most", 1, 1)])
    got = sorted(map(repr, [(r.a, r.t, r.window_s, r.n_events, r.sum_value, r.n_kinds, r.least, r.most) for r in out.collect()]))
    assert got == sorted(map(repr, [
        ("k", 10, 1, 0, 0, 0, None, None), ("k", 10, 2, 0, 0, 0, None, None), ("k", 11, 1, 1, 4, 1, 4, 4), ("k", 11, 2, 1, 4, 1, 4, 4), ("k", 12, 1, 1, 9, 1, 9, 9), ("k", 12, 2, 2, 13, 2, 4, 9),
        (None, 12, 1, 0, 0, 0, None, None), (None, 12, 2, 0, 0, 0, None, None), ("k", None, 1, None, None, None, None, None), ("k", None, 2, None, None, None, None, None),
    ]))


def test_tree_counts_and_ranks_by_weight():
    r = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 64, 100):
        v, w = r.integers(0, 9, n), r.integers(1, 5, n)
        t = rolling.MergeSortTree(v, w)
        lo, hi = np.array([(a, b) for a in range(n + 1) for b in range(a, n + 1)]).T
        for top in (0, 4, 9):
            assert t.between(lo, hi, np.full(len(lo), top)).tolist() == [int(w[a:b][v[a:b] < top].sum()) for a, b in zip(lo, hi, strict=True)]
        some = [sorted(np.repeat(v[a:b], w[a:b])) for a, b in zip(lo, hi, strict=True)]
        rank = np.array([-(-len(s) // 3) for s in some])
        assert t.ranked(lo, hi, rank, 9).tolist() == [int(s[k - 1]) if s else 0 for s, k in zip(some, rank, strict=True)]
