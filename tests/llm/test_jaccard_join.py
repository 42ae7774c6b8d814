import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.llm import jaccard_join as J
from quadrille.llm import overlaps, workspace
from quadrille.llm import sketch as cm
from quadrille.llm.components import connected_components


def sets(rows, k):
    out = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        out.append((i, {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()))
    return out


def grouped(nodes, edges):
    top = {n: n for n in nodes}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain(rows, k, num, den):
    s = sets(rows, k)
    edges = [(a, b) for x, (a, p) in enumerate(s) for b, q in s[:x] if p and q and a is not None and b is not None and den * len(p & q) >= num * len(p | q)]
    top = grouped([i for i, _ in rows if i is not None], edges)
    distinct = {(i, frozenset(p)) for i, p in s if p and i is not None}
    links = {(i, p): sum(1 for j, q in distinct if (j != i or q != p) and den * len(p & q) >= num * len(p | q)) for i, p in distinct}
    return sorted([(i, len(p), top.get(i), links.get((i, frozenset(p)), 0)) for i, p in s], key=repr)


def result(df, *a):
    return sorted([tuple(r) for r in J.ngram_jaccard_join(df, *a).collect()], key=repr)


def near(n, r, words=60, edits=6):
    base = [f"w{r.randrange(50)}" for _ in range(words)]
    rows = []
    for _ in range(n):
        if r.random() < 0.15:
            base = [f"w{r.randrange(50)}" for _ in range(r.randrange(3, words))]
        w = list(base)
        for _ in range(r.randrange(edits)):
            w[r.randrange(len(w))] = f"e{r.randrange(40)}"
        rows.append(" ".join(w[r.randrange(3) :]))
    return rows


@pytest.mark.parametrize(("k", "num", "den"), [(4, 85, 100), (5, 80, 100), (2, 50, 100)])
def test_components_are_those_of_all_pairs(make_docs, messy, k, num, den):
    r = random.Random(k)
    rows = [*messy, messy[6], (None, messy[6][1]), *((100 + i, t) for i, t in enumerate(near(150, r)))]
    r.shuffle(rows)
    assert result(make_docs(rows).repartition(3), k, num, den) == plain(rows, k, num, den)


def test_full_sketch_and_small_batches_lose_no_link(spark, make_docs, monkeypatch):
    monkeypatch.setattr(cm, "MIN_CELLS", 4)
    monkeypatch.setattr(cm, "MAX_CELLS", 4)
    rows = list(enumerate(near(120, random.Random(9))))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert result(make_docs(rows).repartition(4), 4, 85, 100) == plain(rows, 4, 85, 100)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_blocks_and_parts_of_any_size_give_the_same(spark, make_docs, messy, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_ROWS", 9)
    monkeypatch.setattr(J, "TILE_ROWS", 4)
    monkeypatch.setattr(J, "HOT", 1)
    monkeypatch.setattr(workspace, "WAYS", 2)
    monkeypatch.setattr(cm, "LISTED", 3)
    monkeypatch.setattr(workspace, "SHARE", 1000)
    rows = [*messy, *((100 + i, t) for i, t in enumerate(near(120, random.Random(2))))]
    want = plain(rows, 4, 85, 100)
    assert result(make_docs(rows).repartition(3), 4, 85, 100) == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert result(make_docs(rows).repartition(3), 4, 85, 100) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("few", [1, 3, 10])
def test_overlaps_are_those_of_sets(few, monkeypatch):
    monkeypatch.setattr(overlaps, "FEW", few)
    monkeypatch.setattr(overlaps, "SLAB", 100)
    r = np.random.default_rng(few)
    for n in (0, 1, 2, 17):
        rows = [np.unique(r.integers(0, 40, r.integers(0, 30))).astype(np.uint64) for _ in range(n)]
        got = overlaps.overlaps(np.concatenate([*rows, np.empty(0, np.uint64)]), np.repeat(np.arange(n), [len(x) for x in rows]), n)
        assert all(got[i, j] == len(np.intersect1d(rows[i], rows[j])) for i in range(n) for j in range(n) if i != j)


@pytest.mark.parametrize("listed", [0, 1000])
def test_rows_in_two_parts(spark, monkeypatch, listed):
    monkeypatch.setattr(cm, "LISTED", listed)
    df = spark.createDataFrame([(i if i % 9 else None, "x" * i) for i in range(200)], "k int, text string")
    wanted = spark.createDataFrame([(i,) for i in range(5, 60, 5)], "id long")
    some, rest = cm.parted(df, "k", wanted)
    assert sorted(map(repr, some.unionByName(rest).collect())) == sorted(map(repr, df.collect()))
    assert not {r.k for r in rest.collect()} & set(range(5, 60, 5)) and 10 <= some.count() < 120
    assert cm.parted(df, "k", df.where("k IS NOT NULL").select("k"))[1] is None


def test_a_tie_of_repeated_rows_is_broken_by_the_other_columns(spark, make_docs):
    df = make_docs([(1, "a b c")] * 3).drop("source").select("*", F.monotonically_increasing_id().alias("source"))
    for n in (1, 3):
        for order in ("source", F.desc("source")):
            assert [x.source for x in J.keep_one_of_each_group(df.repartitionByRange(n, order).sortWithinPartitions(order)).collect()] == [min(x.source for x in df.collect())]


def test_no_rows_and_no_words(make_docs):
    assert result(make_docs([])) == []
    assert result(make_docs([(1, None), (2, ""), (3, " "), (None, None)])) == [(1, 0, 1, 0), (2, 0, 2, 0), (3, 0, 3, 0), (None, 0, None, 0)]


def test_one_document_of_each_group_stays(make_docs, messy):
    rows = [*messy, messy[8], (None, "x"), (51, "another text")]
    kept = J.keep_one_of_each_group(make_docs(rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    top = {i: c for i, _, c, _ in plain(rows, 5, 80, 100)}
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted({i for i, c in top.items() if i == c} | {None}, key=repr)


def test_components_of_a_long_chain_and_a_star(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(200, 200 + i) for i in range(40)] + [(300, 300)] + [(r.randrange(400, 500), r.randrange(400, 500)) for _ in range(60)]
    r.shuffle(edges)
    edges_between = [e for e in edges if e[0] != e[1]]
    expected = grouped({x for e in edges_between for x in e}, edges_between)
    got = connected_components(spark.createDataFrame([(b, a) for a, b in edges], "u long, v long")).collect()
    assert sorted(map(tuple, got)) == sorted(expected.items())
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
