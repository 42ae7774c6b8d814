"""Removal of repeated byte strings, exact, by sorting sampled suffixes.

A string of LENGTH bytes is repeated if it starts at two places. Of the suffixes
of all texts only those at anchors are sorted: a string's anchor is where the
least hash of GRAM bytes stands in its first half, so equal strings have the
same anchor, whatever is around them, and more than half of the string follows it.
One anchor serves the strings next to each other that have it, a stretch of
some forty; about one suffix in forty is sorted.

1. A count-min sketch counts what follows the anchors, 116 bytes of LENGTH 200.
   Stretches whose anchor's bytes are estimated to occur once are done.
2. The others are range-partitioned by the leading bytes of their suffix, with
   splitters from a bounded sample; a range of a large corpus is cut further by a
   hash of the bytes that all its repeats share. Equal stretches of a
   flush of some megabytes travel once.
3. In a bucket, suffixes are sorted by multikey quicksort, and so are the
   bytes before the anchors, read backwards. Both orders come with the lengths
   that neighbours share, so that strings at the same distance to their anchors
   are equal if no shorter length stands between them, on either side.
4. A suffix that occurs thousands of times is dealt over WAYS buckets. What its
   parts leave undecided is compared across their boundaries: of equal strings
   of a part one goes on, by its hash, to where those of the other parts are.

No bytes are kept that the sketch could spare, no pair is built, and a task
holds one bucket. Nothing depends on how texts are dealt to tasks. Long texts
are worked on in pieces. Equal stretches of a flush and strings across
boundaries are told by 128 bits of hash, all else by the bytes themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch as cm
from .textgrid import _BASE, _BASE_INVERSE, _powers, buffers, mix, slices
from .workspace import WAYS, durable, spread_join

LENGTH = 200
GRAM = 16
PIECE = 1 << 18  # bytes that are hashed together
FLUSH = 8 << 20  # bytes of stretches that are looked through for copies, and sent, together
HELD = 24 << 20  # bytes of texts in memory until then
RANGE = 1 << 20  # bytes of text for which there is one bucket
RANGES = 4096  # that splitters tell apart; more are cut by hash
SAMPLE = 8 << 20  # bytes of texts of which suffixes may become splitters
LEAD = 32  # bytes of a splitter
HOT = 15  # level of the sketch from which a suffix is dealt in parts: 8192 places or more

_VALUE = mix(np.arange(256, dtype=np.uint64) + np.uint64(0x7C))
_SENT = "bucket long, part int, packed binary"
_FOUND = "k1 long, k2 long, pos int, n int, bucket long, packed binary"


@dataclass(frozen=True)
class Shape:
    length: int

    @property
    def reach(self) -> int:
        """Anchors that a string may have: places in its first half."""
        return self.length // 2 - GRAM + 1

    @property
    def shared(self) -> int:
        """Bytes from the anchor on that are always in the string."""
        return self.length - self.reach + 1


def _hash(total: np.ndarray, start: np.ndarray, size: np.ndarray | int, seed: int = 0) -> np.ndarray:
    """Of size bytes from start on, from the sums of powers before each place."""
    return mix((total[start + size] - total[start]) * _powers(_BASE_INVERSE, len(total))[start] ^ np.uint64(seed))


def _totals(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * _powers(_BASE, len(data)), out=out[1:])
    return out


def stretches(data: np.ndarray, offsets: np.ndarray, shape: Shape) -> Iterator[tuple[np.ndarray, ...]]:
    """For pieces of the texts in data: starts and numbers of strings, anchor, hash of the shared bytes, hash of all bytes of the stretch."""
    for low in range(0, len(data), PIECE):
        part = data[low : low + PIECE + shape.length - 1]
        starts = min(PIECE, len(part) - shape.length + 1)
        if starts <= 0:
            continue
        ok = np.ones(starts, bool)
        for k in range(int(np.searchsorted(offsets, low, "right")), len(offsets)):
            end = int(offsets[k]) - low
            if end - shape.length + 1 >= starts:
                break
            ok[max(0, end - shape.length + 1, int(offsets[k - 1]) - low) : max(0, end)] = False
        at = np.flatnonzero(ok)
        if not len(at):
            continue
        total = _totals(part)
        n = len(part) - GRAM + 1
        value = _hash(total, np.arange(n), GRAM)
        value &= np.uint64(~0xFFFFFF & (1 << 64) - 1)
        value |= np.arange(n, dtype=np.uint64)  # a piece has fewer than 2^24 bytes: of equal hashes the first
        have = 1
        while have < shape.reach:
            step = min(have, shape.reach - have)
            value = np.minimum(value[:-step], value[step:])
            have += step
        anchor = (value[at] & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.append(0, np.flatnonzero((at[1:] != at[:-1] + 1) | (anchor[1:] != anchor[:-1])) + 1)
        count = np.diff(np.append(first, len(at)))
        lo, anchor = at[first], anchor[first]
        yield lo + low, count, anchor + low, _hash(total, anchor, shape.shared, 5), _hash(total, lo, count + shape.length - 1, 9)


def multikey_order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of big-endian words, and the bytes that each row shares with the one before it in that order.

    Multikey quicksort (Bentley and Sedgewick, 1997), all open runs of a depth
    at once: rows of a run are parted by their word at that depth, and only
    rows whose words are equal go on to the next.
    """
    n, depth = words.shape
    order, shared = np.arange(n), np.zeros(n, np.int64)
    run = np.zeros(n, np.int64)  # of each place in the order: where its run begins
    open_at = np.arange(n) if n > 1 else np.zeros(0, np.int64)
    for d in range(depth):
        if not len(open_at):
            break
        w = words[order[open_at], d]
        by = np.lexsort((w, run[open_at]))
        order[open_at] = order[open_at][by]
        w = w[by]
        same_run = np.zeros(len(w), bool)
        same_run[1:] = run[open_at][1:] == run[open_at][:-1]
        differ = np.zeros(len(w), np.uint64)
        differ[1:] = w[1:] ^ w[:-1]
        parts = same_run & (differ != 0)
        shared[open_at[parts]] = 8 * d + sum((differ[parts] >> np.uint64(64 - 8 * k) == 0).astype(np.int64) for k in range(1, 8))
        again = same_run & ~parts
        shared[open_at[again]] = 8 * (d + 1)
        begins = ~again
        run[open_at] = open_at[np.maximum.accumulate(np.where(begins, np.arange(len(w)), 0))]
        more = again.copy()
        more[:-1] |= again[1:]
        open_at = open_at[more]
    return order, shared


def _words(raw: np.ndarray, start: np.ndarray, size: np.ndarray, width: int, backwards: bool = False) -> np.ndarray:
    """size bytes from start on - or before it, backwards - as rows of words, filled up with zeros."""
    columns = -(-width // 8) * 8
    out = np.zeros((len(start), columns), np.uint8)
    for j in range(width):  # a column of a byte for each row
        has = size > j
        out[has, j] = raw[(start[has] - 1 - j) if backwards else (start[has] + j)]
    return out.view(">u8").astype(np.uint64)


@dataclass
class Batch:
    """Stretches: text keys, place of the first string in its text, how far before the anchor it starts, number of strings, whether all are known to be repeated; and their bytes."""

    k1: np.ndarray
    k2: np.ndarray
    pos: np.ndarray
    before: np.ndarray
    n: np.ndarray
    known: np.ndarray
    body: bytes

    def pack(self) -> bytes:
        raw = b"".join(x.astype(kind).tobytes() for x, kind in ((self.k1, np.int64), (self.k2, np.int64), (self.pos, np.uint32), (self.before, np.uint16), (self.n, np.uint16), (self.known, np.uint8))) + self.body
        return len(self.n).to_bytes(4, "little") + len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)

    @staticmethod
    def unpack(packed: bytes) -> Batch:
        n = int.from_bytes(packed[:4], "little")
        raw = pa.decompress(packed[12:], int.from_bytes(packed[4:12], "little"), codec="zstd", asbytes=True)
        out, at = [], 0
        for kind in (np.int64, np.int64, np.uint32, np.uint16, np.uint16, np.uint8):
            size = n * np.dtype(kind).itemsize
            out.append(np.frombuffer(raw[at : at + size], kind).astype(np.int64))
            at += size
        return Batch(*out, raw[at:])

    @staticmethod
    def joined(parts: list[Batch]) -> Batch:
        return Batch(*(np.concatenate([getattr(p, c) for p in parts]) for c in ("k1", "k2", "pos", "before", "n", "known")), b"".join(p.body for p in parts))


def _merged(k1: np.ndarray, k2: np.ndarray, pos: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans of equal texts, with those that touch or overlap as one."""
    order = np.lexsort((pos, k2, k1))
    k1, k2, pos, n = k1[order], k2[order], pos[order], n[order]
    if not len(pos):
        return k1, k2, pos, n
    new = np.ones(len(pos), bool)
    new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
    text = np.cumsum(new) - 1
    lift = int((pos + n).max()) + 2
    end = np.maximum.accumulate(text * lift + pos + n)
    first = np.ones(len(pos), bool)
    first[1:] = text[1:] * lift + pos[1:] > end[:-1]
    at = np.flatnonzero(first)
    last = np.append(at[1:], len(pos)) - 1
    return k1[at], k2[at], pos[at], end[last] - text[at] * lift - pos[at]


def _spans(k1, k2, pos, n) -> pa.RecordBatch:
    k1, k2, pos, n = _merged(k1, k2, pos, n)
    none = pa.nulls(len(n), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.array(pos.astype(np.int32)), pa.array(n.astype(np.int32)), none, pa.nulls(len(n), pa.binary())], names=[c.split()[0] for c in _FOUND.split(", ")])


def _repeated(b: Batch, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each stretch and string (by its place in the stretch): is it repeated; the same number for equal strings of each distance; and the starts of the bodies.

    Rows of the two results are shape.reach long; places past a stretch's end are False and -1.
    """
    size = b.n + shape.length - 1
    start = np.cumsum(size) - size
    raw = np.frombuffer(b.body, np.uint8)
    anchor = start + b.before
    right, right_shared = multikey_order(_words(raw, anchor, size - b.before, shape.length))
    left, left_shared = multikey_order(_words(raw, anchor, b.before, shape.reach - 1, backwards=True))
    many = len(b.n)
    found, number = np.zeros((many, shape.reach), bool), np.full((many, shape.reach), -1, np.int64)
    by_right, by_left = np.empty(many, np.int64), np.empty(many, np.int64)
    for a in range(shape.reach):  # strings that start a bytes before their anchor
        rows = np.flatnonzero((a <= b.before) & (a > b.before - b.n))
        if not len(rows):
            continue
        by_right[right] = np.cumsum(right_shared < shape.length - a)
        by_left[left] = np.cumsum(left_shared < a)
        _, same = np.unique(by_right[rows] * (many + 1) + by_left[rows], return_inverse=True)
        weight = np.bincount(same, weights=1 + b.known[rows])
        found[rows, b.before[rows] - a] = weight[same] > 1
        number[rows, b.before[rows] - a] = same
    return found, number, start


def _open_runs(found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first place and length of runs of True."""
    wide = np.zeros((len(found), found.shape[1] + 2), np.int8)
    wide[:, 1:-1] = found
    step = np.diff(wide, axis=1)
    row, first = np.nonzero(step == 1)
    return row, first, np.nonzero(step == -1)[1] - first


def repeated_spans(texts: DataFrame, length: int, size: int) -> DataFrame:
    """k1, k2, pos, n: each of the n strings of length bytes from byte pos on also starts elsewhere. texts: text, k1 and k2, hashes of it; a span may be given more than once.

    size: bytes of all texts.
    """
    shape = Shape(length)
    if shape.reach < 2:
        raise ValueError(f"strings must have {2 * GRAM + 2} bytes at least: {length}")
    spark = texts.sparkSession

    def shared_bytes(batch):
        return np.concatenate([np.empty(0, np.uint64), *[x[3] for x in stretches(*buffers(batch.column("text")), shape)]])

    sketch = cm.build(texts.select("text"), shared_bytes, 2 * size // shape.reach, depth=2)
    sent = spark.sparkContext.broadcast(sketch)
    ranges = int(np.clip(size // RANGE, 1, RANGES))
    finer = max(1, size // (RANGE * RANGES))

    def leads(data: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, LEAD)[anchor]).view(f"S{LEAD}")[:, 0] if len(anchor) else np.empty(0, f"S{LEAD}")

    def sample(batches):
        for batch in slices(batches):
            data, offsets = buffers(batch.column("text"))
            for _, _, anchor, key, whole in stretches(data, offsets, shape):
                keep = (sent.value.levels(key) > 1) & (mix(whole) % np.uint64(max(1, SAMPLE // (400 * ranges))) == 0)
                yield pa.RecordBatch.from_arrays([pa.array(leads(data, anchor[keep]).tolist(), pa.binary())], names=["lead"])

    some = texts.select("text").sample(min(1.0, SAMPLE / max(1, size)), seed=11).mapInArrow(sample, "lead binary").limit(32 * RANGES).collect()  # a bounded number of short rows
    drawn = np.sort(np.array([bytes(r.lead) for r in some], f"S{LEAD}"))
    splitters = np.unique(drawn[np.linspace(0, len(drawn) - 1, ranges).astype(int)[1:]]) if len(drawn) else drawn

    def candidates(batches):
        held: list[tuple] = []
        text_bytes = stretch_bytes = 0
        for batch in slices(batches, limit=1 << 20):
            data, offsets = buffers(batch.column("text"))
            k1, k2 = (batch.column(c).to_numpy() for c in ("k1", "k2"))
            for lo, n, anchor, key, whole in stretches(data, offsets, shape):
                level = sent.value.levels(key)
                keep = np.flatnonzero(level > 1)
                if not len(keep):
                    continue
                lo, n, anchor, key, whole, level = (x[keep] for x in (lo, n, anchor, key, whole, level))
                row = np.searchsorted(offsets, lo, "right") - 1
                held.append((data, lo, n, anchor, key, whole, level, k1[row], k2[row], lo - offsets[row]))
                stretch_bytes += int(n.sum()) + (length - 1) * len(n)
            text_bytes += len(data)
            if stretch_bytes >= FLUSH or text_bytes >= HELD:
                yield from flush(held)
                held, text_bytes, stretch_bytes = [], 0, 0
        yield from flush(held)

    def flush(held):
        if not held:
            return
        source = np.repeat(np.arange(len(held)), [len(h[1]) for h in held])
        lo, n, anchor, key, whole, level, k1, k2, pos = (np.concatenate([h[i] for h in held]) for i in range(1, 10))
        before = anchor - lo
        order = np.lexsort((n, whole, key))
        new = np.ones(len(order), bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (whole[order][1:] != whole[order][:-1]) | (n[order][1:] != n[order][:-1])
        group = np.cumsum(new) - 1
        copies = np.bincount(group)
        answered = order[copies[group] > 1]
        out = []
        if len(answered):
            s1, s2, sp, sn = _merged(k1[answered], k2[answered], pos[answered], n[answered])
            where = (mix(s1.view(np.uint64)) % np.uint64(ranges * finer)).astype(np.int64)
            by = np.argsort(where, kind="stable")
            for part in np.split(by, np.flatnonzero(np.diff(where[by])) + 1):
                zero = np.zeros(len(part), np.int64)
                out.append((-1 - int(where[part[0]]), -1, Batch(s1[part], s2[part], sp[part], zero, zero, zero, sn[part].astype(np.int64).tobytes())))
        first = order[new]  # one of equal stretches, in the order of what follows the anchors
        lead = np.concatenate([leads(h[0], anchor[first[source[first] == k]]) for k, h in enumerate(held)]) if len(first) else np.empty(0, f"S{LEAD}")
        placed = np.concatenate([first[source[first] == k] for k in range(len(held))])
        known = np.zeros(len(order), bool)
        known[answered] = True
        bucket = np.searchsorted(splitters, lead, "right") * finer + (mix(key[placed]) % np.uint64(finer)).astype(np.int64)
        part = np.where(level[placed] >= HOT, (mix(k1[placed].view(np.uint64)) % np.uint64(WAYS)).astype(np.int64), -1)
        by = np.lexsort((key[placed], part, bucket))
        placed, bucket, part = placed[by], bucket[by], part[by]
        for some in np.split(np.arange(len(placed)), np.flatnonzero((bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1])) + 1):
            rows = placed[some]
            body = b"".join([held[s][0][a:z].tobytes() for s, a, z in zip(source[rows].tolist(), lo[rows].tolist(), (lo[rows] + n[rows] + length - 1).tolist(), strict=True)])
            out.append((int(bucket[some[0]]), int(part[some[0]]), Batch(k1[rows], k2[rows], pos[rows], before[rows], n[rows], known[rows], body)))
        for low in range(0, len(out), 256):
            few = out[low : low + 256]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in few], pa.int64()), pa.array([x[1] for x in few], pa.int32()), pa.array([x[2].pack() for x in few], pa.binary())], names=["bucket", "part", "packed"])

    def whole_buckets(batches):
        last, held = None, []
        for batch in batches:
            for bucket, part, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (bucket, part) != last and held:
                    yield *last, Batch.joined([Batch.unpack(p) for p in held])
                    held = []
                last = bucket, part
                held.append(packed)
        if held:
            yield *last, Batch.joined([Batch.unpack(p) for p in held])

    def settle(batches):
        for bucket, part, b in whole_buckets(batches):
            if bucket < 0:  # spans that a flush has found by itself, with their lengths for bytes
                yield _spans(b.k1, b.k2, b.pos, np.frombuffer(b.body, np.int64))
                continue
            found, number, start = _repeated(b, shape)
            asks = b.known == 0
            row, first, n = _open_runs(found & asks[:, None])
            yield _spans(b.k1[row], b.k2[row], b.pos[row] + first, n)
            if part >= 0:
                yield from across(b, found, number, start)

    def across(b: Batch, found, number, start):
        """Of equal strings of a part one, by hash, for those of other parts."""
        row, j = np.nonzero(number >= 0)
        a = b.before[row] - j
        order = np.lexsort((number[row, j], a))
        new = np.ones(len(order), bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (number[row, j][order][1:] != number[row, j][order][:-1])
        row, j = row[order[new]], j[order[new]]
        known = found[row, j] | (b.known[row] > 0)
        total = _totals(np.frombuffer(b.body, np.uint8))
        one, two = _hash(total, start[row] + j, length, 21), _hash(total, start[row] + j + length // 2, length // 2, 23)
        where = (one % np.uint64(WAYS * finer * ranges)).astype(np.int64)
        by = np.argsort(where, kind="stable")
        for some in np.split(by, np.flatnonzero(np.diff(where[by])) + 1) if len(by) else []:
            r = row[some]
            # strings are carried as stretches of one, their two hashes as the bytes
            pairs = np.stack([one[some], two[some]], axis=1).tobytes()
            zero = np.zeros(len(some), np.int64)
            packed = Batch(b.k1[r], b.k2[r], b.pos[r] + j[some], zero, zero, known[some].astype(np.int64), pairs).pack()
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int32()), pa.array([int(where[some[0]])], pa.int64()), pa.array([packed], pa.binary())], names=[c.split()[0] for c in _FOUND.split(", ")])

    def meet(batches):
        for _, _, b in whole_buckets(batches):
            pairs = np.frombuffer(b.body, np.uint64).reshape(-1, 2)
            _, same = np.unique(pairs.copy().view([("a", np.uint64), ("b", np.uint64)])[:, 0], return_inverse=True)
            weight = np.bincount(same, weights=1 + b.known)
            open_ = np.flatnonzero((weight[same] > 1) & (b.known == 0))
            yield _spans(b.k1[open_], b.k2[open_], b.pos[open_], np.ones(len(open_), np.int64))

    def grouped(rows, work):
        return rows.repartition("bucket", "part").sortWithinPartitions("bucket", "part").mapInArrow(work, _FOUND)

    found = durable(grouped(texts.select("text", "k1", "k2").mapInArrow(candidates, _SENT), settle))
    left = found.where("packed IS NOT NULL").select("bucket", F.lit(0).alias("part"), "packed")
    return found.where("packed IS NULL").unionByName(grouped(left, meet)).select("k1", "k2", "pos", "n")


def _kept(raw: bytes, spans: list[dict] | None, length: int) -> tuple[int, int, bytes]:
    """Bytes removed, runs of them, and what is left."""
    parts, at, removed, runs, last = [], 0, 0, 0, -1
    for a, z in sorted((s["pos"], s["pos"] + s["n"] + length - 1) for s in spans or ()):
        if a > at or not runs:
            if a > last:
                runs += 1
            parts.append(raw[at:a])
        a = max(a, at)
        removed += max(0, z - a)
        at = last = max(at, z)
    return removed, runs, b"".join([*parts, raw[at:]])


def remove_repeated_bytes(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes left) for each row of docs.

    A byte of a text in UTF-8 goes if a string of length bytes that covers it
    starts anywhere else too: in another row or in the same, overlapping or
    not. So all copies go, the first included. Null text is empty; texts
    shorter than length stay whole. Every row counts as a document, whatever its id: rows
    that repeat an id or have none repeat each other's text. kept need not be
    valid UTF-8. An empty table gives an empty result. Other columns are not read.
    """
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), value.alias("text"))
    narrow = narrow.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(7), "text")})
    rows, size = narrow.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    spans = durable(repeated_spans(narrow, length, size).groupBy("k1", "k2").agg(F.collect_list(F.struct("pos", "n")).alias("spans")))
    touched, rest = cm.parted(narrow, "k1", spans.select("k1").distinct(), rows)
    counts = durable(touched.groupBy("k1", "k2").agg(F.count("*").alias("n")))
    joined = spread_join(touched, spans, ["k1", "k2"], counts, "left", part=["doc_id"]).select("doc_id", "text", "spans")

    def finish(batches):
        for batch in slices(batches):
            raw = [v.as_py().encode() for v in batch.column("text")]
            out = [_kept(v, s.as_py(), length) for v, s in zip(raw, batch.column("spans"), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(v) for v in raw], pa.int64()), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([hashlib.sha256(x[2]).hexdigest() for x in out], pa.string()), pa.array([x[2] for x in out], pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    done = joined.mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    if rest is None:
        return done
    zero = F.lit(0).cast("long")
    return done.unionByName(rest.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), F.col("text").cast("binary").alias("kept")))
