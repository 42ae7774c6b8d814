import random
import re
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from quadrille.llm import decontamination as D
from quadrille.llm import tiling


def tokens(t):
    return re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", "".join(c.lower() if c.isascii() else c for c in t or ""))


def plain(a, b, k):
    """Greedy string tiling, by looking at every pair of places again and again; the words of a that are covered."""
    mine, theirs, covered = [False] * len(a), [False] * len(b), 0
    while True:
        best = (k - 1, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not mine[i + n] and not theirs[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < k:
            return covered
        mine[i : i + n] = theirs[j : j + n] = [True] * n
        covered += n


def expected(docs, items, k, threshold):
    out = []
    for i, t in docs:
        found = {}
        for item, text in items:
            a = tokens(text)
            if item is not None and a and (c := plain(a, tokens(t), min(k, len(a))) / len(a)) >= threshold - 1e-9:
                found[item] = max(found.get(item, 0), round(c, 9))
        out.append((i, sorted(found.items())))
    return sorted(out, key=repr)


def result(df):
    rows = df.collect()
    assert all(r.contaminated == bool(r["items"]) and r.n_items == len(r["items"]) for r in rows)
    return sorted([(r.doc_id, [(x.item_id, round(x.coverage, 9)) for x in r["items"]]) for r in rows], key=repr)


@pytest.mark.parametrize("block", [D.BLOCK_BYTES, 400])
@pytest.mark.parametrize("common", [0, 3, D.COMMON])
def test_tiles_are_those_of_brute_force(spark, make_docs, block, common, monkeypatch):
    monkeypatch.setattr(D, "COMMON", common)
    r = random.Random(7)
    say = lambda n: [r.choice("alpha beta gamma delta épsilon zeta".split()) + str(r.randrange(4)) for _ in range(n)]
    items = [(i, say(r.randrange(3, 28))) for i in range(25)]
    docs = []
    for i in range(60):
        _, w = r.choice(items)
        half = len(w) // 2
        pieces = [say(r.randrange(12)), r.choice([w, w[half:] + say(3) + w[:half], w[half:] + w[:half], [*w[:half], "odd", *w[half:]], say(4)]), say(r.randrange(12))]
        docs.append((i, r.choice([" ", ", ", "\n"]).join(x.upper() if r.random() < 0.2 and x.isascii() else x for p in pieces for x in p)))
    items = [(i, " ".join(w)) for i, w in items] + [(50, "zeta1, Beta2"), (51, "épsilon0 alpha3 GAMMA1"), (52, "nowhere")] + [(3, " ".join(items[4][1])), (None, "a b c d e f"), (99, None), (98, "")]
    docs += [(None, docs[0][1]), docs[1], (70, None), (71, ""), (72, "one two")]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("item_id", "text", "1 AS items", "2 AS doc_id")
    df = make_docs(docs)
    want = expected(docs, items, 5, 0.8)
    assert result(D.contamination(df, bench, block_bytes=block)) == want
    assert sum(bool(x) for _, x in want) > 20
    clean = [repr(i) for i, x in want if not x]
    assert sorted(repr(x.doc_id) for x in D.drop_contaminated(df, bench, block_bytes=block).collect()) == sorted(clean)


def test_reordered_sentences_are_caught_and_shared_words_are_not(spark, make_docs):
    item = "the quick brown fox jumps over the lazy dog while seven small wizards quietly boil their soup"
    w = item.split()
    rows = [(1, " ".join(w[8:] + ["and", "then"] + w[:8])), (2, " ".join(sorted(w))), (3, " ".join(w[:8])), (4, "x " * 5000 + item)]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [x.doc_id for x in D.contamination(make_docs(rows), bench).where("contaminated").orderBy("doc_id").collect()] == [1, 4]


@pytest.mark.parametrize("limit", [1, 2, 7, tiling.LIMIT])
@pytest.mark.parametrize("few", [-1, tiling.FEW])
def test_tiles_of_few_words_with_few_matches_held(limit, few, monkeypatch):
    monkeypatch.setattr(tiling, "PAIRS", 16)
    monkeypatch.setattr(tiling, "FEW", few)
    r = random.Random(limit)
    for _ in range(150):
        letters = r.choice([1, 2, 3, 6])
        a, b = ([r.randrange(letters) for _ in range(r.randrange(30))] for _ in "ab")
        k = r.randrange(1, 5)
        found = tiling.tiles(np.array(a, np.uint64) + np.uint64(9), np.array(b, np.uint64) + np.uint64(9), k, limit)
        assert sum(n for _, _, n in found) == plain(a, b, k)
        assert all(a[i : i + n] == b[j : j + n] for i, j, n in found)


def test_equal_words_without_end(spark, make_docs):
    tracemalloc.start()
    began = time.perf_counter()
    item, text = "la " * 5_000, "la " * 50_000
    hits = D._hits(pa.array([text, text + "so", "lo " * 50_000]), D.Block.of([(1, item)], 5), 5, 0.8)
    assert {r: [x for x, _ in v] for r, v in hits.items()} == {0: [1], 1: [1]}
    assert tracemalloc.get_traced_memory()[1] < 200e6 and time.perf_counter() - began < 20
    tracemalloc.stop()
    two = " ".join(random.Random(1).choice("ab") for _ in range(20_000))
    assert D._hits(pa.array([two]), D.Block.of([(1, two[:3000])], 5), 5, 0.8) == {0: [(1, 1.0)]}


def test_texts_of_two_words_take_no_long_searches(monkeypatch):
    r = np.random.default_rng(1)
    item, text = (r.integers(0, 2, n).astype(np.uint64) + np.uint64(9) for n in (1_500, 20_000))
    began = time.process_time()
    found = tiling.tiles(item, text, 5)
    assert time.process_time() - began < 2
    monkeypatch.setattr(tiling, "FEW", 1 << 60)
    assert found == tiling.tiles(item, text, 5)


def test_given_up_seeds_leave_no_way_to_the_threshold():
    r = random.Random(3)
    for _ in range(300):
        size, n, threshold = r.randrange(5, 40), r.randrange(1, 6), r.choice([0.5, 0.8, 1.0])
        common = [(r.randrange(3), r.randrange(12), place) for place in range(size - n + 1)]
        common = [(s % 3, s, p) for _, s, p in common]
        seeds, total = D.given_up(common, size, n, threshold)
        words = {w for _, s, p in common if s in seeds for w in range(p, p + n)}
        assert len(words) == total and total / size < threshold
        for rest in {s for _, s, _ in common} - set(seeds):
            more = words | {w for _, s, p in common if s == rest for w in range(p, p + n)}
            assert len(more) / size >= threshold - 1e-9


@pytest.mark.parametrize("block", [D.BLOCK_BYTES, 1])
def test_a_passage_in_all_items_and_texts_makes_no_pairs(spark, make_docs, block):
    passage = "choose the one right answer to the question that follows here"
    own = lambda i: " ".join(f"w{i}x{n}" for n in range(9))
    items = [(i, f"{passage} {own(i)}") for i in range(10_000)]
    docs = [(i, f"{passage} {own(i + 9_700)} indeed" if i % 2 else f"so {passage} {own(-1 - i)}") for i in range(600)]
    bench, df = spark.createDataFrame(items, "item_id long, text string"), make_docs(docs)
    hits = {r.doc_id: [x.item_id for x in r["items"]] for r in D.contamination(df, bench, block_bytes=block).collect()}
    assert hits == {i: [i + 9_700] if i % 2 and i < 300 else [] for i in range(600)}
    if block == 1:
        texts = df.select(*D._keyed(df.text), df.text)
        met, able = D._candidates(texts, bench.select("item_id", *D._keyed(bench.text, D._ITEM[1:]), "text"), 5, 0.8)
        assert met.count() < 20 * 600 and able.count() == 150
    else:
        most = D.Block.of(items, 5)
        assert max(np.unique(most.seeds[5][0], return_counts=True)[1]) <= D.COMMON


def test_empty_tables(spark, make_docs, messy):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.contamination(make_docs([]), none).count() == 0
    assert D.contamination(make_docs(messy), none).where("contaminated").count() == 0
    assert D.drop_contaminated(make_docs(messy), none).count() == len(messy)
