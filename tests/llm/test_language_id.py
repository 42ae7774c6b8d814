import zlib

import numpy as np
import pyarrow as pa
import pytest

from quadrille.llm import language_id as L
from quadrille.llm import textgrid as G


@pytest.fixture(scope="module")
def sf(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def network(sf):
    return L.train(sf)


def test_gradients_are_those_of_small_steps():
    r = np.random.default_rng(0)
    net = L.Network.fresh(["a", "b", "c"], 3)
    net.filters = [f.astype(np.float64) for f in net.filters]
    net.bias, net.weight, net.shift = net.bias.astype(np.float64), net.weight.astype(np.float64), net.shift.astype(np.float64)
    x, y = r.integers(0, 30, (6, 40)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])

    def loss():
        net._pairs = None
        return -np.log(net.probabilities(x)[np.arange(6), y]).mean()

    for p, g in zip([*net.filters, net.bias, net.weight, net.shift], net._gradients(x, y), strict=True):
        for i in r.choice(p.size, min(12, p.size), replace=False):
            at = np.unravel_index(i, p.shape)
            old = p[at]
            p[at] = old + 1e-5
            up = loss()
            p[at] = old - 1e-5
            down = loss()
            p[at] = old
            assert abs((up - down) / 2e-5 - g[at]) < 1e-4


def test_windows_cover_every_symbol():
    texts = ["", None, "Ab  c1.2d", "É" * 200 + "x", "  ", "é ö"]
    x, text = L.windows(*G.buffers(pa.array(texts)), length=16)
    for i, t in enumerate(texts):
        want = " ".join("".join(c if c.isalpha() else " " for c in (t or "").lower()).split(" "))
        while "  " in want:
            want = want.replace("  ", " ")
        got = x[text == i].ravel()
        raw = np.frombuffer(want.strip().encode(), np.uint8)
        assert len(got) == -(-len(got) // 16) * 16 and bytes(got[got > 0]) == bytes(L._SYMBOL[raw][L._SYMBOL[raw] > 0])


def test_held_out_accuracy(sf, network):
    rows = L.identify_language(sf, network).join(sf.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == sf.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and r.lang_pred != L.UNKNOWN]
    assert len(held) > 150 and np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def forward(text, network):
    """The network applied to a whole text in plain loops: symbols, joined spaces, windows, filters, pools, softmax, weighted mean."""
    raw = text.encode()
    kept = []
    for n, b in enumerate(raw):
        c = L._SYMBOL[b]
        if n and raw[n - 1] == 0xC3 and 0x80 <= b <= 0x9E and b != 0x97:
            c = L._SYMBOL[b + 0x20]
        if c or (kept and kept[-1]):
            kept.append(int(c))
    total, weight = np.zeros(len(network.languages)), 0
    for low in range(0, len(kept), L.LENGTH):
        x = kept[low : low + L.LENGTH] + [0] * (L.LENGTH - len(kept[low : low + L.LENGTH]))
        pools = []
        for w, t in zip(L.WIDTHS, network.filters, strict=True):
            pools += [max(sum(float(t[j][x[at + j]][f]) for j in range(w)) for at in range(L.LENGTH - w + 1)) for f in range(L.FILTERS)]
        z = np.maximum(np.array(pools) + network.bias, 0) @ network.weight + network.shift
        e = np.exp(z - z.max())
        n = sum(c > 0 for c in x)
        total, weight = total + n * e / e.sum(), weight + n
    best = int(total.argmax())
    return network.languages[best], total[best] / total.sum()


def test_predictions_are_those_of_a_plain_forward_pass(sf, network):
    texts = [r.text for r in sorted(sf.where("length(text) < 900").collect(), key=lambda r: r.doc_id)[:25]] + ["ÉTÉ été  1,2 à", "a", "x" * 300 + " the", "東京 und"]
    names, score = L._predict(pa.array(texts), network)
    for t, name, s in zip(texts, names, score, strict=True):
        want, most = forward(t, network)
        assert name == want and s == pytest.approx(most, abs=1e-4), t


def test_without_labels_only_texts_without_a_letter_go(make_docs):
    docs = make_docs([(1, "The end."), (2, "東京"), (3, None), (4, "12 !"), (5, "")]).selectExpr("doc_id", "text", "cast(null AS string) lang")
    for keep in (L.keep_learned, L.keep_identified):
        assert sorted(r.doc_id for r in keep(docs).collect()) == [1, 2]


def test_a_sample_of_any_number_of_languages_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(L, "SAMPLE", 40)
    docs = spark.range(2000).selectExpr("id AS doc_id", "concat('text ', id) AS text", "concat('l', id % 8) AS lang")
    sample = L._sample(docs, "doc_id", "text", "lang")
    assert len(sample) == 40 and len({x[0] for x in sample}) == 8


def test_labels_held_out_teach_nothing(spark, sf, network):
    from pyspark.sql import functions as F

    changed = sf.withColumn("lang", F.when(L._remainder("doc_id") == 0, F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit(None).cast("string"))
    again = L.train(changed)
    assert again.languages == network.languages and all(np.array_equal(a, b) for a, b in zip(again.filters, network.filters, strict=True))


def test_rows_of_every_kind(spark, make_docs, messy, network):
    rows = [*messy, (70, "12 345 !?"), (71, "😀😀"), (72, "東京"), (None, "the and of"), messy[6]]
    got = L.identify_language(make_docs(rows), network).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and not by[None].held_out
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (0, 1, 2, 70, 71)) and by[72].lang_pred != "und"
    kept = L.keep_identified(make_docs(rows), network)
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(repr(r.doc_id) for r in got if r.lang_pred != "und")
    assert L.identify_language(make_docs([])).count() == 0
    bare = make_docs(rows).drop("lang").selectExpr("*", "cast(null AS string) lang")
    assert {r.lang_pred for r in L.identify_language(bare).collect()} == {"und"}


def test_filter_drops_gibberish_and_scripts_not_learned(spark, sf, make_docs):
    import random

    r = random.Random(4)
    learned = L.train(sf, reject=True)
    assert learned.most >= 0.75 and learned.familiar is not None
    letters = [c for row in sf.limit(50).collect() for c in row.text.lower() if c.isalpha()]

    def mash(n, alphabet):
        return " ".join("".join(r.choice(alphabet) for _ in range(r.randrange(2, 10))) for _ in range(n))

    bad = [mash(n, a) for n in (15, 60, 600) for a in ("abcdefghijklmnopqrstuvwxyz", letters) for _ in range(5)]
    bad += ["東京", "東京は日本の首都です。" * 30, "Это обычный русский текст о погоде.", "Η Αθήνα είναι η πρωτεύουσα της Ελλάδας", "القاهرة هي عاصمة مصر", None, "", "12 345 !?", "😀😀"]
    good = ["The end.", "Avec.", "Yes 😀😀😀😀", "ÉAUX.", "The house stands at the end of the road, and in the evening the children play there until the lamps are lit. 東京"]
    docs = make_docs([*enumerate(bad), *enumerate(good, 1000)])
    assert sorted(x.doc_id for x in L.keep_learned(docs, learned).collect()) == list(range(1000, 1000 + len(good)))
    # and of the documents it was trained for, held out or not, none but a few go
    kept = L.keep_learned(sf, learned)
    assert kept.columns == sf.columns and kept.count() >= 0.998 * sf.count()
    assert {x.lang_pred for x in L.identify_language(docs, learned).collect()} <= {"de", "en", "es", "fr", "und"}


def test_stage_of_the_pipeline_uses_the_network(spark, sf):
    from pyspark.sql import functions as F

    import corpus_pipeline

    gibberish = sf.limit(20).select((F.col("doc_id") + 10_000_000).alias("doc_id"), F.concat(F.reverse(F.md5("text")), F.repeat(F.lit("qxzj wvkq xxjz pqgk "), 20)).alias("text"), F.lit(None).cast("string").alias("lang"), "source", "n_chars")
    out = corpus_pipeline.language_id_stage(spark, sf.unionByName(gibberish), None)
    assert out.where("doc_id >= 10000000").count() == 0 and out.count() >= 0.998 * sf.count()
