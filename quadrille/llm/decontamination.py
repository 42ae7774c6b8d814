"""Benchmark decontamination by greedy string tiling (Wise, 1993).

Words are runs of letters and digits with ASCII case folded. Karp-Rabin hashes
of every run of MIN_MATCH words of a document are joined with those of the
benchmark; seeds grow into maximal matches; the longest match of unmarked words
is marked again and again, in document and item, until none of MIN_MATCH words
is left. A document is contaminated by an item of whose words at least THRESHOLD
is covered by tiles, whatever their order in the document. An item of fewer
words than MIN_MATCH has one seed, the whole of it.

Documents are read once, whatever the size of the benchmark. One of at most
BLOCK_BYTES is sent to all tasks, and no document moves. Beyond that, a bounded
count-min sketch of its seeds lets each document give out only seeds that the
benchmark may have; they meet the benchmark's in a join, pairs whose seeds could
not cover enough are dropped while counts are still partial, and only the texts
of the pairs left are tiled. Both ways give the same rows.

A tile's words all stand in seeds that the document has. So an item may give up
seeds, its most common ones first, as long as the words in them are fewer than
THRESHOLD asks: no document reaches it by those alone, and a pair that meets in
no other seed need not be looked at. Only seeds that more than COMMON texts, or
places of a benchmark that is sent, have are given up; so boilerplate in all items
and all documents makes no pairs, and the rest of the bound stays sharp.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch as cm
from .textgrid import ALPHANUMERIC_FOLDED, Words, buffers, inside_one_text, rolled, slices, words
from .tiling import tiles
from .workspace import durable, spread_join

MIN_MATCH = 5
THRESHOLD = 0.8
BLOCK_BYTES = 16 << 20
COMMON = 256  # a seed that more texts or places have is given up, if its item can do without
EXPANDED = 1 << 20  # places of seeds in items that are looked at at once, for whole rows

_HIT = "array<struct<item_id:long,coverage:double>>"
_KEY = ["text_a", "text_b"]
_ITEM = ["item_id", "item_a", "item_b"]


def _words(column: pa.Array) -> Words:
    return words(*buffers(column), ALPHANUMERIC_FOLDED)


def _seeds(w: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and place in the text of every run of n words; runs of other lengths have other hashes."""
    at = np.flatnonzero(inside_one_text(w.first, n, len(w.hash) - n + 1))
    text = np.searchsorted(w.first, at, "right") - 1
    return rolled(w.hash, n, seed=n)[at], text, at - w.first[text]


def _of_length(w: Words, k: int):
    """For each length of seeds, n, and which texts have seeds of it: those of n words, or of k and more."""
    size = np.diff(w.first)
    for n in np.unique(np.minimum(size[size > 0], k)).tolist():
        yield n, size >= k if n == k else size == n


def given_up(common: list[tuple[int, int, int]], size: int, n: int, threshold: float) -> tuple[list[int], int]:
    """Seeds of n words that an item of size words can do without, and how many words they cover.

    common: (how common, seed, place) of its common seeds. The most common go
    first; a seed goes with all its places, or not at all.
    """
    order = sorted(common, key=lambda x: (-x[0], x[1], x[2]))
    covered, seeds, total = np.zeros(size, bool), [], 0
    for (_, seed), places in groupby(order, key=lambda x: x[:2]):
        after = covered.copy()
        for _, _, place in places:
            after[place : place + n] = True
        if (count := int(after.sum())) / size < threshold - 1e-9:
            covered, total = after, count
            seeds.append(seed)
    return seeds, total


@dataclass
class Block:
    """Items, their word hashes, how many of their words stand in seeds given up, and by length of seed the other seeds sorted by hash with the item and place of each."""

    ids: np.ndarray
    words: list[np.ndarray]
    given: np.ndarray
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]

    @staticmethod
    def of(items: list[tuple[int, str]], k: int, threshold: float = THRESHOLD) -> Block:
        w, seeds = _words(pa.array([t for _, t in items], pa.string())), {}
        size, given = np.diff(w.first), np.zeros(len(items), np.int64)
        for n, which in _of_length(w, k):
            seed, item, place = _seeds(w, n)
            own = which[item]
            order = np.argsort(seed[own], kind="stable")
            seed, item, place = (x[own][order] for x in (seed, item, place))
            _, group, places = np.unique(seed, return_inverse=True, return_counts=True)
            common = np.flatnonzero(places[group] > COMMON)
            common = common[np.argsort(item[common], kind="stable")]
            kept = np.ones(len(seed), bool)
            for i, own in groupby(common.tolist(), key=lambda x: item[x]):
                own = list(own)
                gone, given[i] = given_up([(int(places[group[x]]), int(group[x]), int(place[x])) for x in own], int(size[i]), n, threshold)
                kept[own] = ~np.isin(group[own], gone)
            seeds[n] = seed[kept], item[kept], place[kept]
        return Block(np.array([i for i, _ in items], np.int64), [w.hash[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)], given, seeds)


def _distinct(seed: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each seed once for a row, by row."""
    order = np.lexsort((seed, row))
    seed, row = seed[order], row[order]
    keep = np.ones(len(seed), bool)
    keep[1:] = (seed[1:] != seed[:-1]) | (row[1:] != row[:-1])
    return seed[keep], row[keep]


def _reachable(seed: np.ndarray, row: np.ndarray, found: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, length: np.ndarray, given: np.ndarray, threshold: float):
    """Pairs of row and item whose common seeds, were all of them and those given up marked, would cover enough."""
    known, of_item, at = found
    low, high = np.searchsorted(known, seed, "left"), np.searchsorted(known, seed, "right")
    some = high > low
    row, low, count = row[some], low[some], (high - low)[some]
    first = np.append(np.flatnonzero(np.append(True, row[1:] != row[:-1])), len(row)) if len(row) else np.zeros(1, np.int64)
    total = np.append(0, np.cumsum(count))[first]  # places of the rows before each
    begin = 0
    while begin < len(first) - 1:
        end = max(begin + 1, int(np.searchsorted(total, total[begin] + EXPANDED, "right")) - 1)
        s = slice(first[begin], first[end])
        begin = end
        c = count[s]
        which = np.repeat(low[s], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        r, item, place = np.repeat(row[s], c), of_item[which], at[which]
        order = np.lexsort((place, item, r))
        r, item, place = r[order], item[order], place[order]
        new = np.append(True, (r[1:] != r[:-1]) | (item[1:] != item[:-1]))
        step = np.full(len(r), n)
        step[:-1] = np.where(new[1:], n, np.minimum(n, np.diff(place)))
        most = np.bincount(np.cumsum(new) - 1, weights=step) + given[item[new]]
        enough = most >= threshold * length[item[new]] - 1e-9
        yield from zip(r[new][enough].tolist(), item[new][enough].tolist(), strict=True)


def _coverage(item: np.ndarray, document: np.ndarray, k: int) -> float:
    return sum(n for _, _, n in tiles(item, document, min(k, len(item)))) / len(item)


def _hits(batch_text: pa.Array, block: Block, k: int, threshold: float) -> dict[int, list[tuple[int, float]]]:
    """For rows of the batch: the items that contaminate them, with coverage."""
    out: dict[int, list[tuple[int, float]]] = {}
    w = _words(batch_text)
    length = np.array([len(x) for x in block.words], np.int64)
    for n, found in block.seeds.items():
        seed, row, _ = _seeds(w, n)
        if not len(seed) or not len(found[0]):
            continue
        hit = found[0][np.minimum(np.searchsorted(found[0], seed), len(found[0]) - 1)] == seed
        for r, item in _reachable(*_distinct(seed[hit], row[hit]), found, n, length, block.given, threshold):
            covered = _coverage(block.words[item], w.hash[w.first[r] : w.first[r + 1]], k)
            if covered >= threshold - 1e-9:
                out.setdefault(r, []).append((int(block.ids[item]), covered))
    return out


def _items(benchmark: DataFrame) -> DataFrame:
    """Items with an id and a text, once each."""
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL").distinct()


def _sent(benchmark: DataFrame, k: int, threshold: float, block_bytes: int):
    """The benchmark for all tasks, or None if it has more than block_bytes."""
    items = _items(benchmark)
    if items.agg(F.coalesce(F.sum(F.octet_length("text") + 8), F.lit(0))).first()[0] > block_bytes:
        return None
    # of at most block_bytes, as just seen
    return benchmark.sparkSession.sparkContext.broadcast(Block.of(sorted((r.item_id, r.text) for r in items.collect()), k, threshold))


def _keyed(text, names=("text_a", "text_b")) -> list:
    """128 bits that stand for a text."""
    return [F.xxhash64(F.lit(seed), text).alias(name) for seed, name in zip((41, 43), names, strict=True)]


def _given(placed: DataFrame, common: DataFrame, threshold: float) -> DataFrame:
    """item, seed, given: the seeds that items give up, and how many words of the item all of them cover; common: seed, n."""

    def choose(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                seeds, total = given_up([(x["n"], x["seed"], x["place"]) for x in row["common"]], row["words"], row["width"], threshold)
                out += [(row["item_id"], row["item_a"], row["item_b"], seed, total) for seed in seeds]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (list(zip(*out, strict=True)) or [()] * 5)], names=[*_ITEM, "seed", "given"])

    # what is gathered are places of one item, as many as its words
    placed_common = spread_join(placed.withColumnRenamed("n", "width"), common, ["seed"], placed.groupBy("seed").agg(F.count("*").alias("n")))
    gathered = placed_common.groupBy(*_ITEM, "words", "width").agg(F.collect_list(F.struct("n", "seed", "place")).alias("common"))
    return gathered.mapInArrow(choose, "item_id long, item_a long, item_b long, seed long, given long")


def _candidates(texts: DataFrame, items: DataFrame, k: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Pairs of a text and an item that meet in a seed, with a row for each such seed; and of these the pairs whose seeds could cover enough."""

    def hashes(batch):
        w = _words(batch.column("text"))
        return np.concatenate([np.empty(0, np.uint64), *(seed[which[text]] for n, which in _of_length(w, k) for seed, text, _ in [_seeds(w, n)])])

    sketch = cm.build(items.select("text"), hashes, cm.text_bytes(items) // 4, depth=1)
    lengths = range(1, k + 1)
    sent = texts.sparkSession.sparkContext.broadcast(sketch)

    def of_items(batches):
        for batch in slices(batches):
            w = _words(batch.column("text"))
            size = np.diff(w.first)
            for n, which in _of_length(w, k):
                seed, text, place = _seeds(w, n)
                own = which[text]
                seed, text, place = seed[own], text[own], place[own]
                keys = [batch.column(c).to_numpy()[text] for c in _ITEM]
                yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), *map(pa.array, keys), pa.array(size[text]), pa.array(np.full(len(seed), n)), pa.array(place)], names=["seed", *_ITEM, "words", "n", "place"])

    def of_documents(batches):
        for batch in slices(batches):
            w = _words(batch.column("text"))
            for n in lengths:
                seed, text, _ = _seeds(w, n)
                here = sent.value.levels(seed) > 0
                seed, text = _distinct(seed[here], text[here])
                yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), *(pa.array(batch.column(c).to_numpy()[text]) for c in _KEY)], names=["seed", *_KEY])

    placed = durable(items.mapInArrow(of_items, "seed long, item_id long, item_a long, item_b long, words long, n long, place long"))
    # a seed stands once for a text, however many documents have that
    met = durable(texts.mapInArrow(of_documents, "seed long, text_a long, text_b long").distinct().join(placed.select("seed").distinct(), "seed", "left_semi"))
    counts = met.groupBy("seed").agg(F.count("*").alias("n"))
    given = durable(_given(placed, counts.where(F.col("n") > COMMON), threshold))
    # and once for an item, with the number of its places
    known = placed.join(given.select("seed", *_ITEM), ["seed", *_ITEM], "left_anti").groupBy("seed", *_ITEM, "words", "n").agg(F.count("*").alias("places"))
    known = durable(known.join(given.groupBy(*_ITEM).agg(F.max("given").alias("given")), _ITEM, "left").fillna(0, ["given"]))
    pairs = spread_join(met, known, ["seed"], counts)
    most = F.sum(F.col("places") * F.col("n")) + F.col("given")
    return pairs, pairs.groupBy(*_KEY, *_ITEM, "words", "given").agg(most.alias("most")).where(F.col("most") / F.col("words") >= threshold - 1e-9).select(*_KEY, *_ITEM)


def _joined(docs: DataFrame, benchmark: DataFrame, k: int, threshold: float) -> DataFrame:
    """text_a, text_b, item_id, coverage of all texts of docs (a column text) and items that contaminate them, by joins."""
    items = durable(_items(benchmark).select("item_id", *_keyed(F.col("text"), _ITEM[1:]), "text"))
    texts = docs.select(*_keyed(F.col("text")), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    able = durable(_candidates(texts, items, k, threshold)[1])

    # one text of each key, then its items, in one stream
    wanted = able.select(*_KEY).distinct()
    first = spread_join(texts, wanted, _KEY, texts.groupBy(*_KEY).agg(F.count("*").alias("n")), "left_semi").groupBy(*_KEY).agg(F.first("text").alias("text"))
    with_item = spread_join(able, items, _ITEM, able.groupBy(*_ITEM).agg(F.count("*").alias("n")), part=_KEY)
    rows = first.select(*_KEY, F.lit(0).alias("kind"), F.lit(0).cast("long").alias("item_id"), "text").unionByName(with_item.select(*_KEY, F.lit(1).alias("kind"), "item_id", "text"))

    def tiled(batches):
        document = np.empty(0, np.uint64)
        for batch in slices(batches):
            w, out = _words(batch.column("text")), []
            for r, (a, b, kind, item) in enumerate(zip(*(batch.column(c).to_pylist() for c in (*_KEY, "kind", "item_id")), strict=True)):
                own = w.hash[w.first[r] : w.first[r + 1]]
                if not kind:
                    document = own.copy()
                elif (covered := _coverage(own, document, k)) >= threshold - 1e-9:
                    out.append((a, b, item, covered))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=[*_KEY, "item_id", "coverage"])

    return durable(rows.repartition(*_KEY).sortWithinPartitions(*_KEY, "kind").mapInArrow(tiled, "text_a long, text_b long, item_id long, coverage double"))


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, k: int = MIN_MATCH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, contaminated, n_items, items (item_id and coverage, by id) for each row of docs.

    Items without words, id or text match nothing; an item of fewer than k words
    matches where all its words stand in one run; null and empty texts are clean;
    repeated rows and null ids of docs come through; items that repeat an id count
    as one, with the highest coverage. No documents, or no items, give no rows or
    no contamination. Other columns are not read. Memory follows a bounded number
    of matches, however repetitive texts and items are.
    """
    start = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    block = _sent(benchmark, k, threshold, block_bytes)
    if block is None:
        pairs = _joined(start, benchmark, k, threshold)
        hits = pairs.groupBy(*_KEY, "item_id").agg(F.max("coverage").alias("coverage")).groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("item_id", "coverage"))).alias("items"))
        keyed = start.select("doc_id", *_keyed(F.col("text")))
        found = spread_join(keyed, hits, _KEY, keyed.groupBy(*_KEY).agg(F.count("*").alias("n")), "left").select("doc_id", F.coalesce("items", F.array().cast(_HIT)).alias("items"))
    else:

        def scan(batches):
            for batch in slices(batches):
                found = _hits(batch.column("text"), block.value, k, threshold)
                rows = [[{"item_id": i, "coverage": c} for i, c in found.get(r, [])] for r in range(len(batch))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64())])))], names=["doc_id", "items"])

        best = F.expr("array_sort(transform(array_distinct(items.item_id), i -> struct(i AS item_id, array_max(transform(filter(items, x -> x.item_id = i), x -> x.coverage)) AS coverage)))")
        found = start.mapInArrow(scan, f"doc_id long, items {_HIT}").select("doc_id", best.alias("items"))
    return found.select("doc_id", (F.size("items") > 0).alias("contaminated"), F.size("items").cast("long").alias("n_items"), "items")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, k: int = MIN_MATCH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that no item of the benchmark contaminates, whole."""
    block = _sent(benchmark, k, threshold, block_bytes)
    if block is None:
        key = [f"_{c}" for c in _KEY]
        bad = _joined(docs, benchmark, k, threshold).select(*(F.col(a).alias(b) for a, b in zip(_KEY, key, strict=True))).distinct()
        keyed = docs.select("*", *(c.alias(n) for c, n in zip(_keyed(F.col("text").cast("string")), key, strict=True)))
        return spread_join(keyed, bad, key, keyed.groupBy(*key).agg(F.count("*").alias("n")), "left_anti").select(*docs.columns)
    at = docs.columns.index("text")

    def scan(batches):
        for batch in slices(batches, at):
            found = _hits(batch.column(at), block.value, k, threshold)
            yield batch.filter(pa.array([r not in found for r in range(len(batch))])) if found else batch

    return docs.mapInArrow(scan, docs.schema)
