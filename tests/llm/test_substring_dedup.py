import hashlib
import random
import re

import numpy as np
import pytest

from quadrille.llm import sketch as cm
from quadrille.llm import substring_dedup as D


def plain(rows, window):
    texts = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, w in texts:
        if i is not None:
            for j in range(len(w) - window + 1):
                k = tuple(w[j : j + window])
                least[k] = min(least.get(k, i), i)
    out = []
    for i, w in texts:
        gone = set()
        if i is not None:
            for j in range(len(w) - window + 1):
                if least[tuple(w[j : j + window])] < i:
                    gone.update(range(j, j + window))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def result(df, window):
    return [tuple(r) for r in D.remove_repeated_passages(df, window).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]


order = lambda rows: sorted(rows, key=repr)


@pytest.mark.parametrize("common", [D.COMMON, 0])
def test_words_that_go_are_those_of_brute_force(make_docs, messy, monkeypatch, common):
    monkeypatch.setattr(D, "COMMON", common)
    rows = [*messy, messy[6], (None, messy[6][1]), (51, "other text for the same id " * 5), (-3, messy[-1][1])]
    assert order(result(make_docs(rows).repartition(3), 13)) == order(plain(rows, 13))


def test_small_windows_over_few_words(make_docs):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice("abc") for _ in range(r.randrange(40)))) for i in range(120)]
    for window in (4, 7):
        assert order(result(make_docs(rows), window)) == order(plain(rows, window))


def test_full_sketch_and_groups_over_batches_lose_nothing(spark, make_docs, messy, monkeypatch):
    monkeypatch.setattr(cm, "MIN_CELLS", 4)
    monkeypatch.setattr(cm, "MAX_CELLS", 8)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert order(result(make_docs(messy).repartition(4), 13)) == order(plain(messy, 13))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_rows(make_docs):
    assert result(make_docs([]), 13) == []


def test_sketch_never_underestimates(spark, monkeypatch):
    monkeypatch.setattr(cm, "_ROUND", 2)
    monkeypatch.setattr(cm, "FLUSH", 300)
    values = np.random.default_rng(1).integers(0, 400, 5000)
    df = spark.createDataFrame([(int(v), "") for v in values], "v long, text string").repartition(7)
    s = cm.build(df, lambda b: b.column("v").to_numpy().astype(np.uint64), 400, depth=2)
    true = np.bincount(values, minlength=400)
    levels = s.levels(np.arange(400, dtype=np.uint64))
    expected = np.array([cm.level(int(c)) for c in true])
    assert (levels >= expected).all() and (levels == expected).mean() > 0.9


def test_levels_follow_the_doublings():
    assert [cm.level(c) for c in (0, 1, 2, 3, 4, 7, 8, 100, 10**6)] == [0, 1, 2, 3, 4, 4, 5, 8, 15]
    counts = np.arange(0, 5000, 3)
    packed = cm._packed_levels(counts[: len(counts) // 2 * 2])
    assert [cm.level(int(c)) for c in counts[: 2 * len(packed)]] == list(np.stack([packed & 15, packed >> 4], 1).ravel())


def test_a_window_of_many_documents_is_settled_in_parts(spark, make_docs, monkeypatch):
    monkeypatch.setattr(D, "COMMON", 0)
    r = random.Random(6)
    say = lambda n: " ".join(f"w{r.randrange(500)}" for _ in range(n))
    passage, line = say(40), say(15)
    rows = [(i, f"{say(r.randrange(20))} {passage if i % 3 else line} {say(r.randrange(20))} {line}") for i in r.sample(range(1000), 300)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert order(result(make_docs(rows).repartition(4), 13)) == order(plain(rows, 13))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_few_texts_move_where_passages_go_from_few(make_docs, messy):
    r = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, " ".join(f"u{r.random()}" for _ in range(20)) + (passage if i % 40 == 0 else "")) for i in range(400)] + messy[:6]
    assert order(result(make_docs(rows).repartition(3), 13)) == order(plain(rows, 13))
