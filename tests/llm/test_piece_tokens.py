import random

import numpy as np
import pytest

from quadrille.llm import piece_tokens as P

TEXTS = ["", " ", "   ", "a", "the cat, sat.", " lead  and   trail ", "tab\tnew\nline\r\n", "▁ literal ▁▁ marks▁", "naïve café – 東京 😀 Привет", "x" * 700, "ab" * 400, "don't e.g. U.S.A. 3.14 a_b c++ ²."]


@pytest.fixture(scope="module")
def vocabulary():
    return P.Vocabulary.load()


def plain(text, v):
    """The same rule over the whole text at once, without memory or boundaries."""
    if not text:
        return []
    marked, literal = " " + text, "\0"
    s = "".join(literal if c == P.SPACE else P.SPACE if c == " " else c for c in marked)
    score, back = [0.0], [0]
    for end in range(1, len(s) + 1):
        options = [(score[start] + v.pieces[s[start:end]][1], start - end, start) for start in range(max(0, end - v.longest), end) if s[start:end] in v.pieces]
        if s[end - 1] not in v.pieces:
            options.append((score[end - 1] + v.foreign, -1, end - 1))
        best = max(options, key=lambda o: (o[0], -o[1]))
        score.append(best[0])
        back.append(best[2])
    ids, at = [], len(s)
    while at:
        piece = s[back[at] : at]
        found = v.pieces.get(piece)
        ids = ([found[0]] if found else [v.byte_ids[b] for b in (P.SPACE if piece == literal else piece).encode()]) + ids
        at = back[at]
    return ids


def texts_of(r):
    return [*TEXTS, *("".join(r.choice("abcdet  .,'▁\né²1") for _ in range(r.randrange(80))) for _ in range(300))]


def test_ids_are_those_of_the_whole_lattice(vocabulary):
    v = P.Vocabulary({p: (i, s / 1000) for p, (i, s) in vocabulary.pieces.items()}, vocabulary.byte_ids)
    for t in texts_of(random.Random(1)):
        assert list(P.encode(t, v)) == plain(t, v), t


def test_ids_are_those_of_the_vocabularys_own_encoder(vocabulary, spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=P.MODEL)
    assert vocabulary.merging
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    for t in [*texts_of(random.Random(2)), *docs, "Tokenization of 12,345 unbelievably long words: antidisestablishmentarianism!!!", "  " * 40, "a" * 5000, "la la" * 900, "こんにちは世界、おはよう"]:
        if P.SPACE not in t:  # one of the text itself is not a space here
            assert list(P.encode(t, vocabulary)) == model.encode(t), t


def test_any_vocabulary_converges():
    r = random.Random(2)
    for _ in range(40):
        pieces = {"".join(r.choice("ab▁.") for _ in range(r.randrange(1, 7))) for _ in range(r.randrange(1, 25))} | {P.SPACE}
        v = P.Vocabulary({p: (i + 300, -float(r.randrange(5))) for i, p in enumerate(sorted(pieces))}, list(range(256)))
        for _ in range(10):
            t = "".join(r.choice("ab .") for _ in range(r.randrange(120)))
            assert list(P.encode(t, v)) == plain(t, v)
            assert P.Decoder(v).decode(P.encode(t, v)) == t


@pytest.mark.parametrize("distinct", [True, False])
def test_any_merges_give_what_merging_gives(distinct):
    r = random.Random(3)
    for _ in range(150):
        pieces = {"".join(r.choice("abc") for _ in range(r.randrange(1, 6))) for _ in range(r.randrange(1, 30))}
        order = r.sample(range(len(pieces)), len(pieces)) if distinct else [r.randrange(4) for _ in pieces]
        v = P.Vocabulary({p: (i + 300, -float(n)) for i, (p, n) in enumerate(zip(sorted(pieces), order, strict=True))}, list(range(256)), merging=True)
        merges = P.Merges(v.pieces)
        for _ in range(20):
            t = "".join(r.choice("abcd") for _ in range(r.randrange(60)))
            want = [i for p in merges.apply(t)[0] for i in ([v.pieces[p][0]] if p in v.pieces else p.encode())]
            assert P.viterbi(t, v, merges) == want, (t, v.pieces)


def test_letters_that_pieces_join_end_no_stretch():
    v = P.Vocabulary({p: (i + 300, s) for i, (p, s) in enumerate([("▁", -9.0), ("▁can", -1.0), ("▁ca", -3.0), ("n't", -3.0), ("'", -5.0), ("t", -5.0), ("n", -5.0)])}, list(range(256)))
    for t in ("can't", "can", "cann't can"):
        assert list(P.encode(t, v)) == plain(t, v), t


def test_stretches_do_not_change_the_ids(vocabulary, monkeypatch):
    text = " ".join(TEXTS) * 3
    expected = list(P.encode(text, vocabulary))
    monkeypatch.setattr(P, "STRETCH", 5)
    monkeypatch.setattr(P, "REMEMBERED", 3)
    assert list(P.encode(text, P.Vocabulary(vocabulary.pieces, vocabulary.byte_ids, vocabulary.merging))) == expected


def test_round_trip_of_rows(make_docs, messy, vocabulary):
    rows = [*messy, *((100 + i, t) for i, t in enumerate(TEXTS)), messy[6], (None, "x y")]
    out = P.encode_documents(make_docs(rows), vocabulary)
    got = out.collect()
    assert len(got) == len(rows) and all(r.round_trip is (None if r.ids is None else True) for r in got)
    assert sorted(map(repr, rows)) == sorted(repr(tuple(r)) for r in P.decode_documents(out, vocabulary).collect())
    assert {r.doc_id: r.n_ids for r in got}[0] is None and {r.doc_id: r.n_ids for r in got}[1] == 0
    assert P.encode_documents(make_docs([]), vocabulary).count() == 0
    assert P.Decoder(vocabulary).decode(np.empty(0, np.int32)) == ""
