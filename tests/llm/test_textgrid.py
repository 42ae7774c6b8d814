import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quadrille.llm import textgrid as G


@pytest.mark.parametrize("size", [7, 64, 1 << 20])
def test_words_are_those_of_the_pattern(monkeypatch, size):
    monkeypatch.setattr(G, "SLICE", size)
    r = random.Random(size)
    texts = ["", None, "a", " a", "a ", "x" * 500] + ["".join(r.choice("ab é\t\n\x0b\x1cß ") for _ in range(r.randrange(60))) for _ in range(200)]
    column = pa.array(["zz", *texts, "y"])[1:-1]
    data, offsets = G.buffers(column)
    w = G.words(data, offsets, G.WHITESPACE)
    seen = {}
    for i, t in enumerate(texts):
        expected = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        a, b = w.first[i], w.first[i + 1]
        assert [bytes(data[s:e]).decode() for s, e in zip(w.start[a:b], w.end[a:b], strict=True)] == expected
        for word, h in zip(expected, w.hash[a:b], strict=True):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_shingles_are_those_of_the_lists():
    r = random.Random(1)
    texts = [" ".join(r.choice("abc") for _ in range(r.randrange(12))) for _ in range(300)]
    w = G.words(*G.buffers(pa.array(texts)), G.WHITESPACE)
    values, at = G.shingle_sets(w, 4)
    seen = {}
    for i, t in enumerate(texts):
        x = t.split()
        expected = {tuple(x[j : j + 4]) for j in range(max(1, len(x) - 3))} if x else set()
        assert at[i + 1] - at[i] == len(expected)
        seen.setdefault(frozenset(expected), set()).add(tuple(values[at[i] : at[i + 1]]))
    assert all(len(v) == 1 for v in seen.values())
    assert len(set().union(*seen.values())) == len(seen)


def test_no_text_and_no_row():
    for texts in ([], [None], ["", ""]):
        w = G.words(*G.buffers(pa.array(texts, pa.string())), G.WHITESPACE)
        assert len(w.hash) == 0 and len(w.first) == len(texts) + 1
        values, at = G.shingle_sets(w, 4)
        assert len(values) == 0 and list(at) == [0] * (len(texts) + 1)
    assert np.all(G.mix(np.arange(5)) == G.mix(np.arange(5)))


def test_slices_keep_all_rows_in_order():
    r = random.Random(6)
    texts = [None if r.random() < 0.1 else "é" * r.randrange(9) for _ in range(200)] + ["x" * 100, "y" * 100]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    for limit in (1, 10, 64, 10**6):
        parts = list(G.slices([batch, batch.slice(5, 0)], limit=limit))
        assert [t for p in parts for t in p.column(0).to_pylist()] == texts
        assert all(len(p) == 1 or sum(len((t or "").encode()) for t in p.column(0).to_pylist()) <= limit for p in parts)
