"""Language identification by a convolutional network over bytes.

Filters of several widths slide over one-hot bytes, each is max-pooled over a
window of fixed length, and a softmax layer reads the pools. Training is
gradient descent (Adam) written out in numpy, on the driver, on a bounded
sample: at most PER_LANGUAGE documents of each language, those with the
smallest hashes of their ids, and of each at most SNIPPET characters. The bounds
on the sample are SAMPLE documents and LANGUAGES labels, the most frequent ones. Counts of labels come first and set how small a
hash must be, so that what is ranked is bounded as well. Prediction reads every byte of every text in batches of windows and averages the windows.

Before windows are cut, case is folded, ASCII that is no letter becomes a
space, and spaces are joined.

For the filter, the network has one more class, REJECT, trained on made-up
windows: random letters, letters of learned windows in random order, few
letters again and again. A text goes if
that class gets more of it than held-out texts of the sample show (and three
quarters at least), or if half of its letters or more are in scripts that no learned
language uses; characters of such scripts are spaces to the network. A text of fewer than JUDGED symbols goes by its script alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textgrid import buffers, slices

PER_LANGUAGE = 400  # documents, fewer where there are so many languages that SAMPLE would be passed
SAMPLE = 40_000  # documents of all languages together
SNIPPET = 4096
LANGUAGES = 10_000
WINDOWS = 3000  # of each language, in training; fewer as for documents
LENGTH = 128
WIDTHS = (2, 3, 4)
FILTERS = 16
EPOCHS = 4
UNKNOWN = "und"
REJECT = None  # as no label is null
JUDGED = 48  # symbols that a text must have for the class REJECT to decide
SPARED = 0.998  # of the held-out texts lie at or below the threshold
FAMILIAR = 1e-4  # of a language's letters that a pair of bytes must make up
_HASHES = 1 << 40

# symbols: 0 space and other ASCII, 1-26 letters, 27-154 bytes from 128 on
_SYMBOLS = 155
_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[65:91] = _SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[128:] = np.arange(27, 155)
_LATIN = 27 + 0xC3 - 128  # the byte before Latin capitals and small letters with accents


def symbols(data: np.ndarray) -> np.ndarray:
    out = _SYMBOL[data]
    capital = np.zeros(len(out), bool)
    if len(out):
        capital[1:] = (out[:-1] == _LATIN) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[capital] += 0x20
    return out


def windows(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Windows that cover all symbols of all texts, the last of a text filled with spaces, and the text of each."""
    s = symbols(data)
    keep = np.ones(len(s), bool)
    if len(s):
        keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
        at = offsets[:-1][offsets[:-1] < len(s)]
        keep[at] = s[at] != 0
    left = np.append(0, np.cumsum(keep))[offsets]
    s = s[keep]
    size = np.diff(left)
    count = -(-size // length)
    first = np.cumsum(count) - count
    text = np.repeat(np.arange(len(size)), count)
    out = np.zeros((len(text), length), np.uint8)
    place = np.arange(len(s)) - np.repeat(left[:-1] - first * length, size)
    out.ravel()[place] = s
    return out, text


@dataclass
class Network:
    languages: list[str | None]
    filters: list[np.ndarray]  # of each width: (width, symbols, filters)
    bias: np.ndarray
    weight: np.ndarray  # (pools, languages)
    shift: np.ndarray
    familiar: np.ndarray | None = None  # pairs of symbols, at the start of a character, that the languages use; with it, the last class is REJECT
    most: float = 0.75  # of a text that REJECT may get

    def __post_init__(self):
        self._pairs = None

    @staticmethod
    def fresh(languages: list[str], seed: int = 0) -> Network:
        r = np.random.default_rng(seed)
        pools = FILTERS * len(WIDTHS)
        return Network(languages, [r.normal(0, 0.5 / w, (w, _SYMBOLS, FILTERS)).astype(np.float32) for w in WIDTHS], np.zeros(pools, np.float32), r.normal(0, 0.1, (pools, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))

    def _pooled(self, x: np.ndarray) -> np.ndarray:
        """Largest response of each filter in each window; responses to two neighbouring symbols come from one table."""
        if self._pairs is None:
            self._pairs = [[(t[j][:, None, :] + t[j + 1][None, :, :]).reshape(-1, FILTERS) if j + 1 < len(t) else t[j] for j in range(0, len(t), 2)] for t in self.filters]
        two = x[:, :-1].astype(np.int32) * _SYMBOLS + x[:, 1:]
        out = []
        for w, tables in zip(WIDTHS, self._pairs, strict=True):
            n = x.shape[1] - w + 1
            total = tables[0][two[:, :n]]
            for j, table in enumerate(tables[1:], 1):
                total += table[(two if 2 * j + 1 < w else x)[:, 2 * j : 2 * j + n]]
            out.append(total.max(axis=1))
        return np.concatenate(out, axis=1)

    def probabilities(self, x: np.ndarray, batch: int = 256) -> np.ndarray:
        out = np.empty((len(x), len(self.languages)), np.float64)
        for low in range(0, len(x), batch):
            h = np.maximum(self._pooled(x[low : low + batch]) + self.bias, 0)
            z = (h @ self.weight + self.shift).astype(np.float64)
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out[low : low + batch] = z / z.sum(axis=1, keepdims=True)
        return out

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.01, seed: int = 1) -> Network:
        r = np.random.default_rng(seed)
        parameters = [*self.filters, self.bias, self.weight, self.shift]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]
        step = 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for low in range(0, len(x), batch):
                some = order[low : low + batch]
                self._pairs = None
                for p, (m, v), g in zip(parameters, moments, self._gradients(x[some], y[some]), strict=True):
                    m *= 0.9
                    m += 0.1 * g
                    v *= 0.999
                    v += 0.001 * g * g
                    p -= rate * (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(v / (1 - 0.999 ** (step + 1))) + 1e-8)
                step += 1
        self._pairs = None
        return self

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        pools, where = [], []
        for w, t in zip(WIDTHS, self.filters, strict=True):
            n = x.shape[1] - w + 1
            total = t[0][x[:, :n]]
            for j in range(1, w):
                total += t[j][x[:, j : j + n]]
            where.append(total.argmax(axis=1))
            pools.append(total.max(axis=1))
        before = np.concatenate(pools, axis=1) + self.bias
        h = np.maximum(before, 0)
        z = h @ self.weight + self.shift
        z = np.exp(z - z.max(axis=1, keepdims=True))
        d = z / z.sum(axis=1, keepdims=True)
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        back = (d @ self.weight.T) * (before > 0)
        out = []
        rows, columns = np.arange(len(x))[:, None], np.arange(FILTERS)[None, :]
        for k, (w, t) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            g, part = np.zeros_like(t), back[:, k * FILTERS : (k + 1) * FILTERS]
            for j in range(w):
                np.add.at(g[j], (x[rows, where[k] + j], np.broadcast_to(columns, part.shape)), part)
            out.append(g)
        return [*out, back.sum(axis=0), h.T @ d, d.sum(axis=0)]


def _remainder(key: str):
    return F.crc32(F.col(key).cast("string")) % 5


def _share(each: int, languages: int) -> int:
    """So many of each language that PER_LANGUAGE of each, or as many as SAMPLE has room for, is the measure."""
    return max(4, each * min(PER_LANGUAGE, SAMPLE // max(languages, 1)) // PER_LANGUAGE)


def _sample(docs: DataFrame, key: str, text: str, lang: str, held: bool = False) -> list[tuple[str, int, str]]:
    """(lang, hash, snippet) of a bounded number of labelled texts of each language; of held-out ones, or of the others."""
    side = _remainder(key) == 0
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (side if held else ~side)).withColumn("_lang", F.col(lang).cast("string"))
    counts = labelled.groupBy("_lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "_lang").limit(LANGUAGES).collect()
    if not counts:
        return []
    each = _share(PER_LANGUAGE, len(counts))
    # some four times what is needed passes, whatever the count
    least = F.broadcast(docs.sparkSession.createDataFrame([(r._lang, min(_HASHES, -(-4 * each * _HASHES // r.n))) for r in counts], "_lang string, _least long"))  # LANGUAGES rows at most
    hashed = F.pmod(F.xxhash64(F.lit(17), F.col(key).cast("string")), F.lit(_HASHES))
    spread = F.pmod(F.xxhash64(F.lit(18), F.col(key).cast("string")), F.greatest(F.length(F.col(text)) - SNIPPET + 1, F.lit(1)))
    drawn = labelled.join(least, "_lang").where(hashed < F.col("_least"))
    snippets = drawn.select(F.col("_lang").alias("lang"), hashed.alias("h"), F.substring(F.col(text), (spread + 1).cast("int"), F.lit(SNIPPET)).alias("text"))
    ranked = snippets.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text")))
    return sorted((r.lang, r.h, r.text) for r in ranked.where(F.col("nth") <= each).collect())


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", reject: bool = False) -> Network | None:
    """A network for the languages of the sample, with the class REJECT if asked for; None if there is no labelled text."""
    sample = _sample(docs, key, text, lang)
    languages = sorted({x[0] for x in sample})
    r, xs, ys = np.random.default_rng(2), [], []
    for k, name in enumerate(languages):
        x, _ = windows(*buffers(pa.array([t for n, _, t in sample if n == name], pa.string())))
        x = x[x.any(axis=1)]
        if len(x):
            most = _share(WINDOWS, len(languages))
            x = x[r.permutation(len(x))[:most]]
            x = x[np.arange(max(len(x), min(most, 500))) % len(x)]
            # short texts occur as well: some windows end early
            x = x.copy()
            cut = r.integers(8, LENGTH, len(x))
            short = r.random(len(x)) < 0.2
            x[short[:, None] & (np.arange(LENGTH)[None, :] >= cut[:, None])] = 0
            xs.append(x)
            ys.append(np.full(len(x), k))
    if not xs:
        return None
    if not reject:
        return Network.fresh(languages).train(np.concatenate(xs), np.concatenate(ys))
    made = _made_up(np.concatenate(xs), 2 * WINDOWS, np.random.default_rng(3))
    network = Network.fresh([*languages, REJECT]).train(np.concatenate([*xs, made]), np.concatenate([*ys, np.full(len(made), len(languages))]))
    network.familiar = np.zeros((_SYMBOLS, _SYMBOLS), bool)
    for name in languages:
        seen, letters = np.zeros((_SYMBOLS, _SYMBOLS), np.int64), 0
        for _, _, t in (x for x in sample if x[0] == name):
            pairs, n = _leads(np.frombuffer(t.encode(), np.uint8))
            np.add.at(seen, (pairs[0], pairs[1]), 1)
            letters += n
        network.familiar |= seen > FAMILIAR * letters
    held = pa.array([t for _, _, t in _sample(docs, key, text, lang, held=True)], pa.string())
    if len(held):
        data, offsets = buffers(held)
        share, size = _shares(_without(data, _strange(data, network)), offsets, network)
        if (size >= JUDGED).any():
            network.most = max(network.most, float(np.quantile(share[size >= JUDGED, -1], SPARED)))
    return network


def _leads(data: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], int]:
    """The first two symbols of each character beyond ASCII, and the number of characters that are one or an ASCII letter."""
    s = symbols(data)
    lead = np.flatnonzero(data[:-1] >= 0xC0)
    return (s[lead], s[lead + 1]), len(lead) + int(((s > 0) & (data < 128)).sum())


def _made_up(x: np.ndarray, n: int, r: np.random.Generator) -> np.ndarray:
    """n windows of no language, some of which end early; x: windows of all."""
    out = np.zeros((n, x.shape[1]), np.uint8)
    for k in range(n):
        row = x[r.integers(len(x))]
        kind = k % 3
        if kind == 0:  # any letters, in words of any length
            made = r.integers(1, 27, len(row))
            made[r.random(len(row)) < r.uniform(0.05, 0.25)] = 0
        elif kind == 1:  # letters of a learned window in random order, its spaces stay
            made = row.copy()
            made[row > 0] = r.permutation(row[row > 0])
        else:  # few letters again and again
            made = r.choice(r.integers(1, 27, r.integers(1, 9)), len(row))
            made[r.random(len(row)) < r.uniform(0, 0.2)] = 0
        if r.random() < 0.2:
            made = made[: r.integers(JUDGED, len(row))]
        out[k, : len(made)] = made
    return out


def _shares(data: np.ndarray, offsets: np.ndarray, network: Network) -> tuple[np.ndarray, np.ndarray]:
    """What each class gets of each text, and the symbols of each text that are letters."""
    x, text = windows(data, offsets)
    p = network.probabilities(x)
    weight = (x > 0).sum(axis=1)
    total = np.zeros((len(offsets) - 1, p.shape[1]))
    np.add.at(total, text, p * weight[:, None])
    return total / np.maximum(total.sum(axis=1, keepdims=True), 1e-300), np.bincount(text, weight, len(offsets) - 1)


def _some_letter(column: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    letter = np.append(0, np.cumsum((_SYMBOL[data] > 0) & (data < 128)))[offsets]
    some = np.diff(letter) > 0
    for i in np.flatnonzero(~some & (np.diff(offsets) > 0)):
        some[i] = any(c.isalpha() for c in column[int(i)].as_py() or "")
    return some


def _predict(column: pa.Array, network: Network | None) -> tuple[list[str], np.ndarray]:
    """The language and score of each text."""
    n = len(column)
    if network is None:
        return [UNKNOWN] * n, np.zeros(n)
    data, offsets = buffers(column)
    some = _some_letter(column, data, offsets)
    share, _ = _shares(data, offsets, network)
    if network.familiar is not None:
        share = share[:, :-1]
    best = share.argmax(axis=1)
    return [network.languages[b] if s else UNKNOWN for b, s in zip(best, some, strict=True)], np.where(some, np.clip(share.max(axis=1), 0, 1), 0.0)


def _strange(data: np.ndarray, network: Network) -> np.ndarray:
    """Which bytes begin a character of a script that the network's languages do not use."""
    lead = np.flatnonzero(data >= 0xC0)
    s = symbols(data)
    out = np.zeros(len(data), bool)
    out[lead] = ~network.familiar[s[lead], s[lead + 1]]
    return out


def _without(data: np.ndarray, strange: np.ndarray) -> np.ndarray:
    """data with spaces for these characters."""
    if not strange.any():
        return data
    begins = (data & 0xC0) != 0x80
    return np.where(strange[begins][np.cumsum(begins) - 1], np.uint8(32), data)


def _learned(column: pa.Array, network: Network | None) -> np.ndarray:
    """Whether each text has a letter and is neither the class REJECT's nor in scripts that the network's languages do not use; a letter will do without a network."""
    data, offsets = buffers(column)
    some = _some_letter(column, data, offsets)
    if network is None:
        return some
    strange = _strange(data, network)
    share, size = _shares(_without(data, strange), offsets, network)
    some &= (size < JUDGED) | (share[:, -1] <= network.most)
    letter = (data >= 0xC0) | ((_SYMBOL[data] > 0) & (data < 128))
    n_strange, n_letter = (np.diff(np.append(0, np.cumsum(v))[offsets]) for v in (strange, letter))
    # signs and emoji are no script: where strange characters could decide, only letters count
    for i in np.flatnonzero(some & (2 * n_strange >= n_letter) & (n_strange > 0)):
        own, low = column[int(i)].as_py(), int(offsets[i])
        first = np.flatnonzero((data[low : offsets[i + 1]] & 0xC0) != 0x80)
        alpha = np.fromiter((c.isalpha() for c in own), bool, len(own))
        some[i] = 2 * int((strange[low + first] & alpha).sum()) < int(alpha.sum())
    return some


def identify_language(docs: DataFrame, network: Network | None = None, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs.

    Without a network, one is trained on rows of docs with text and label whose
    crc32(id) mod 5 is not 0; only the text enters a prediction. Text that is
    null or has no letter is `und` with score 0, and so is all if nothing is
    labelled. Null ids are never learned from, and not held out. Repeated rows
    come through; other columns are not read; no row moves between tasks.
    """
    sent = docs.sparkSession.sparkContext.broadcast(network or train(docs, key, text, lang))

    def scan(batches):
        for batch in slices(batches):
            names, score = _predict(batch.column("text"), sent.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(_remainder(key) == 0, F.lit(False)).alias("held_out"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(scan, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, network: Network | None = None, least: float = 0.0) -> DataFrame:
    """The rows of docs, whole, whose text has a language: not `und`, and with a score of at least least. Where nothing is labelled, those with a letter."""

    def kept(column, network):
        if network is None:
            return _learned(column, None)
        names, score = _predict(column, network)
        return np.array([n != UNKNOWN and s >= least for n, s in zip(names, score, strict=True)], bool)

    return _keep(docs, network or train(docs), kept)


def keep_learned(docs: DataFrame, network: Network | None = None) -> DataFrame:
    """The rows of docs, whole, whose text is in a learned language by the rule above; network: one with the class REJECT."""
    return _keep(docs, network or train(docs, reject=True), _learned)


def _keep(docs: DataFrame, network: Network | None, kept) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(network)
    at = docs.columns.index("text")

    def scan(batches):
        for batch in slices(batches, at):
            yield batch.filter(pa.array(kept(batch.column(at), sent.value), pa.bool_()))

    return docs.mapInArrow(scan, docs.schema)
