"""Removal of repeated passages, exact, behind a count-min prefilter.

The first pass sketches windows by their anchor: the least hash among the
shorter shingles inside the window, the same wherever the window stands. One
anchor serves the windows around it, so a sketch of anchors is a fraction of
one of windows, and its estimate for a window can only be too high. The second
pass groups, by their whole hashes, only windows estimated in two documents or
more, so none is lost. A batch keeps the smallest document of each window it
sees and settles the rest by itself: a window that a third of all documents
share leaves one row per batch. Anchors estimated in many documents - many more
than a cell of the sketch holds on average - are dealt by window instead of by
anchor, so that no group gathers unrelated windows, and each window in parts: a
part settles all but its smallest document, and those of all parts meet in a
second round. So a group has a bounded number of rows, or a part's share of them.

Texts are shuffled only where passages go: the words of all others are counted
and hashed where they are read, unless passages go from half of all texts or more.

Windows are told apart by an anchor hash and a window hash of 64 bits each,
made from 64-bit word hashes. Batches are worked on in slices of a few megabytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch as cm
from .textgrid import WHITESPACE, Words, buffers, inside_one_text, mix, rolled, slices, words
from .workspace import WAYS, durable

WINDOW = 13
COMMON = 100  # estimated documents, beyond the load of the sketch, from which an anchor's windows are dealt one by one, in parts

_FOUND = "key long, part int, doc_id long, text_key long, pos int, windows binary"
_SPAN = "key long, doc_id long, text_key long, pos int, n int, open binary"


def _anchors(w: Words, window: int) -> np.ndarray:
    """For each position of a window: the least hash of the shorter shingles inside it."""
    short = window // 2
    values = rolled(w.hash, short, seed=11)
    need, have = window - short + 1, 1
    while have < need and len(values):
        step = min(have, need - have)
        values = np.minimum(values[:-step], values[step:]) if len(values) > step else values[:0]
        have += step
    return values


def _windows(batch: pa.RecordBatch, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Words]:
    """Anchors, positions and rows of all windows of rows with an id."""
    w = words(*buffers(batch.column("text")), WHITESPACE)
    n = len(w.hash) - window + 1
    ok = inside_one_text(w.first, window, n)
    at = np.flatnonzero(ok)
    row = (np.searchsorted(w.first, at, "right") - 1).astype(np.int64)
    if batch.column("doc_id").null_count:
        named = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)[row]
        at, row = at[named], row[named]
    return _anchors(w, window)[at] if len(at) else np.empty(0, np.uint64), at, row, w


def _distinct_anchors(batch: pa.RecordBatch, window: int) -> np.ndarray:
    """Anchors, one for each document of the batch that has it."""
    anchor, _, row, _ = _windows(batch, window)
    doc = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)[row]
    fresh = np.ones(len(anchor), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    anchor, doc = anchor[fresh], doc[fresh]
    order = np.lexsort((doc, anchor))
    anchor, doc = anchor[order], doc[order]
    keep = np.ones(len(anchor), bool)
    keep[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    return anchor[keep]


def _least(*keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The smallest doc among equal keys, for each."""
    order = np.lexsort((doc, *keys))
    new = np.zeros(len(doc), bool)
    if len(doc):
        new[0] = True
        for k in keys:
            k = k[order]
            new[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(new)
    least = np.empty(len(doc), doc.dtype)
    least[order] = np.repeat(doc[order][first], np.diff(np.append(first, len(doc))))
    return least


def _runs(*breaks: np.ndarray) -> np.ndarray:
    """Starts of runs: 0, and where any of the breaks (of n-1 flags) is set."""
    return np.append(0, np.flatnonzero(np.logical_or.reduce(breaks)) + 1)


def repeated_spans(docs: DataFrame, window: int = WINDOW, size: int | None = None) -> DataFrame:
    """doc_id, text_key, pos, n: each of the n windows from word pos on also starts in a document with a smaller id.

    docs: doc_id long, text string, text_key long, the same for equal texts. size: the bytes of all texts, if they are known.
    """
    expected = (cm.text_bytes(docs) if size is None else size) // 24  # about a word in four starts a new anchor
    sketch = cm.build(docs.select("doc_id", "text"), lambda batch: _distinct_anchors(batch, window), expected, depth=2)
    hot = cm.level(COMMON + int(8 * sketch.load))
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def candidates(batches):
        for batch in slices(batches):
            anchor, at, row, w = _windows(batch, window)
            level = shared.value.levels(anchor)
            keep = level >= 2
            anchor, at, row, level = anchor[keep], at[keep], row[keep], level[keep]
            if not len(at):
                continue
            whole = rolled(w.hash, window, seed=12)[at]
            doc = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)[row]
            text = batch.column("text_key").to_numpy(zero_copy_only=False)[row]
            pos = at - w.first[row]
            settled = doc > _least(anchor, whole, doc=doc)
            common = level >= hot
            part = np.where(common, (mix(doc.astype(np.uint64)) % np.uint64(WAYS)).astype(np.int64), -1)
            key = np.where(common, mix(anchor ^ mix(whole)), anchor)
            start = _runs(row[1:] != row[:-1], at[1:] != at[:-1] + 1, key[1:] != key[:-1], settled[1:] != settled[:-1])
            bounds = np.append(start, len(at))
            raw = np.ascontiguousarray(whole).view(np.uint8)
            # settled runs carry only their length, and travel by a key of their own
            payload = [(int(b - a).to_bytes(4, "little")) if settled[a] else raw[8 * a : 8 * b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            key = np.where(settled, mix(key + mix(at.astype(np.uint64))), key)[start]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(part[start].astype(np.int32)), pa.array(doc[start]), pa.array(text[start]), pa.array(pos[start].astype(np.int32)), pa.array(payload, pa.binary())],
                names=[x.split()[0] for x in _FOUND.split(", ")],
            )

    def settle(batches):
        held: list[pa.Table] = []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not len(table):
                continue
            key, part = table.column("key").to_numpy(), table.column("part").to_numpy()
            same = (key == key[-1]) & (part == part[-1])
            cut = len(table) - int(same[::-1].argmin()) if not same.all() else 0
            if held and (cut or (held[-1].column("key")[-1].as_py(), held[-1].column("part")[-1].as_py()) != (key[0], part[0])):
                yield _settled(pa.concat_tables([*held, table.slice(0, cut)]))
                held = []
            elif cut:
                yield _settled(table.slice(0, cut))
            held.append(table.slice(cut))  # the last group may go on in the next batch
        if held:
            yield _settled(pa.concat_tables(held))

    def grouped(rows):
        return rows.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(settle, _SPAN)

    found = durable(grouped(docs.select("doc_id", "text", "text_key").mapInArrow(candidates, _FOUND)))
    # of windows dealt in parts, the smallest documents of each part
    left = found.where("open IS NOT NULL").select("key", F.lit(-1).alias("part"), "doc_id", "text_key", "pos", F.col("open").alias("windows"))
    return found.where("open IS NULL").unionByName(grouped(left)).select("doc_id", "text_key", "pos", "n")


def _settled(table: pa.Table) -> pa.RecordBatch:
    """Spans of windows that a smaller document holds too, of whole groups of keys; and, of groups that are parts, windows that none holds there."""
    payload = table.column("windows").combine_chunks()
    if isinstance(payload, pa.ChunkedArray):
        payload = payload.chunk(0) if payload.num_chunks else pa.array([], pa.binary())
    key, part, doc, text, pos = (table.column(c).to_numpy() for c in ("key", "part", "doc_id", "text_key", "pos"))
    raw, offsets = buffers(payload)
    size = np.diff(offsets)
    done = size == 4
    lengths = np.where(done, 0, size // 8)
    row = np.repeat(np.arange(len(doc)), lengths)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    whole = np.frombuffer(raw[np.repeat(~done, size)].tobytes(), np.uint64)
    gone = doc[row] > _least(key[row], part[row], whole, doc=doc[row]) if len(row) else np.zeros(0, bool)
    stays = np.flatnonzero(~gone & (part[row] >= 0))
    open_row, open_at, left = row[stays], nth[stays], np.ascontiguousarray(whole[stays])
    row, nth = row[gone], nth[gone]
    start = _runs(row[1:] != row[:-1], nth[1:] != nth[:-1] + 1) if len(row) else np.zeros(0, np.int64)
    count = np.diff(np.append(start, len(row)))
    begin = np.repeat(offsets[:-1][done], 4) + np.tile(np.arange(4), int(done.sum()))
    known = np.frombuffer(raw[begin].tobytes(), np.uint32).astype(np.int64)
    who = np.concatenate([row[start], np.flatnonzero(done)])
    shift = np.concatenate([nth[start], np.zeros(len(known), np.int64)])
    n = np.concatenate([count, known, np.ones(len(open_row), np.int64)])
    windows = _eights(len(who), left)
    who, shift = np.concatenate([who, open_row]), np.concatenate([shift, open_at])
    return pa.RecordBatch.from_arrays([*map(pa.array, (key[who], doc[who], text[who], (pos[who] + shift).astype(np.int32), n.astype(np.int32))), windows], names=[x.split()[0] for x in _SPAN.split(", ")])


def _eights(nulls: int, values: np.ndarray) -> pa.Array:
    """A binary column of nulls, and then of the eight bytes of each value."""
    offsets = np.concatenate([np.zeros(nulls, np.int32), 8 * np.arange(len(values) + 1, dtype=np.int32)])
    valid = pa.array(np.arange(nulls + len(values)) >= nulls)
    return pa.Array.from_buffers(pa.binary(), nulls + len(values), [valid.buffers()[1], pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def _kept(value: str | None, spans: list[dict] | None, window: int) -> tuple[int, int, bytes]:
    found = (value or "").encode().split()  # at exactly the bytes 09-0D and 20
    n = len(found)
    if not spans:
        return n, 0, b" ".join(found)
    gone = bytearray(n)
    for s in spans:
        a, b = s["pos"], s["pos"] + s["n"] + window - 1
        gone[a:b] = b"\1" * (b - a)
    return n, sum(gone), b" ".join([x for x, g in zip(found, gone, strict=True) if not g])


def remove_repeated_passages(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the text left) for each row of docs.

    A word goes if a window that covers it also starts in a document with a
    smaller id. Rows with a null id keep all words and take none from others;
    null text has no words; texts shorter than a window stay whole. Rows that
    repeat an id do not repeat each other's windows. Other columns are not read.
    """
    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    rows, size = narrow.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    spans = durable(repeated_spans(narrow, window, size).groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("pos", "n")).alias("spans")))
    touched, rest = cm.parted(narrow, "text_key", spans.select("text_key").distinct(), rows)
    joined = touched.join(spans, ["doc_id", "text_key"], "left").select("doc_id", "text", "spans")
    if rest is not None:
        joined = joined.unionByName(rest.select("doc_id", "text", F.lit(None).cast(joined.schema["spans"].dataType).alias("spans")))

    def finish(batches):
        for batch in slices(batches):
            out = [_kept(v.as_py(), s.as_py(), window) for v, s in zip(batch.column("text"), batch.column("spans"), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([hashlib.sha256(x[2]).hexdigest() for x in out], pa.string()), pa.array([x[2].decode() for x in out], pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
            )

    return joined.mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
