"""Vectorised word tables over Arrow string batches.

Texts stay UTF-8 bytes. Word boundaries come from a byte class and word hashes
from prefix sums of a polynomial modulo 2**64, so that a batch costs a few
numpy passes and no Python object per word. Work runs in slices cut between
words: temporary memory follows the slice size, not the length of a document.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def mix_int(x: int) -> int:
    return int(mix(np.array([x & (1 << 64) - 1], np.uint64))[0])


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE + 4096), base, np.uint64)
        steps[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(steps)
    return have[:n]


@dataclass(frozen=True)
class ByteClass:
    """Which bytes belong to words, and the value each contributes to a hash."""

    inside: np.ndarray
    value: np.ndarray


def byte_class(separators: bytes | None = b" \t\n\v\f\r", fold_ascii: bool = False) -> ByteClass:
    """separators: bytes between words; None: every ASCII byte but letters and digits."""
    inside = np.ones(256, bool)
    if separators is None:
        inside[:128] = [chr(i).isalnum() for i in range(128)]
    else:
        inside[list(separators)] = False
    fold = np.arange(256, dtype=np.uint64)
    if fold_ascii:
        fold[65:91] += np.uint64(32)
    return ByteClass(inside, mix(fold + np.uint64(0x51)))


WHITESPACE = byte_class()
WHITESPACE_FOLDED = byte_class(fold_ascii=True)
ALPHANUMERIC_FOLDED = byte_class(None, fold_ascii=True)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n+1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, body = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(body, np.uint8) if body is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterable[pa.RecordBatch], text: int | str = "text", limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in pieces of at most limit bytes of text, or of one row, so that memory follows limit."""
    for batch in batches:
        _, offsets = buffers(batch.column(text))
        low = 0
        while low < len(batch):
            high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
            yield batch.slice(low, high - low)
            low = high


@dataclass
class Words:
    """Words of all texts of a batch, in order: byte span, 64-bit hash and, per text, the first word."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # n texts + 1

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(data: np.ndarray, offsets: np.ndarray, kind: ByteClass) -> Words:
    size = len(data)
    cuts = np.unique(offsets)
    starts, ends, hashes = [], [], []
    low = 0
    while low < size:
        high = min(size, low + SLICE)
        while high < size:  # move the cut to a separator or the start of a text
            stretch = kind.inside[data[high - 1 : high + 4095]]
            gap = np.flatnonzero(~stretch)
            stop = high - 1 + int(gap[0]) + 1 if len(gap) else min(size, high + 4095)
            k = np.searchsorted(cuts, high)
            edge = int(cuts[k]) if k < len(cuts) else size
            if edge <= stop:
                high = edge
                break
            high = stop
            if len(gap):
                break
        part = data[low:high]
        inside = kind.inside[part]
        edge = np.zeros(high - low + 1, bool)
        a, b = np.searchsorted(cuts, [low, high], "left")
        edge[cuts[a : b + 1][cuts[a : b + 1] <= high] - low] = True
        edge[0] = edge[-1] = True
        before = np.empty_like(inside)
        before[0] = False
        before[1:] = inside[:-1]
        s = np.flatnonzero(inside & (~before | edge[:-1]))
        if len(s):
            after = np.empty_like(inside)
            after[-1] = False
            after[:-1] = inside[1:]
            e = np.flatnonzero(inside & (~after | edge[1:])) + 1
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(kind.value[part] * _powers(_BASE, len(part)), out=total[1:])
            h = (total[e] - total[s]) * _powers(_BASE_INVERSE, len(part))[s]
            hashes.append(mix(h ^ (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
            starts.append(s + low)
            ends.append(e + low)
        low = high
    join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
    start = join(starts, np.int64)
    return Words(start, join(ends, np.int64), join(hashes, np.uint64), np.searchsorted(start, offsets, "left"))


def _factor(j: int, seed: int) -> np.uint64:
    return np.uint64(mix_int(seed * 1000003 + j + 1) | 1)


def rolled(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A hash of every k consecutive values, across texts too; the caller masks those."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += hashes[j : j + n] * _factor(j, seed)
    return mix(out)


def whole(hashes: np.ndarray, k: int, seed: int = 0) -> np.uint64:
    """The hash of a sequence shorter than k, never equal by rule to one of k."""
    factors = np.array([_factor(j, seed) for j in range(len(hashes))], np.uint64)
    start = np.array([mix_int(len(hashes) + (seed << 8) + 77)], np.uint64)
    return mix(start + (hashes * factors).sum(keepdims=True))[0]


def inside_one_text(first: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of the n rolled positions keep all k words in one text."""
    ok = np.ones(max(n, 0), bool)
    if n > 0:
        for j in range(1, k):
            at = first[1:-1] - j
            ok[at[(at >= 0) & (at < n)]] = False
    return ok


def shingle_sets(w: Words, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each text: sorted values, and n+1 offsets. Texts of 1 to k-1 words give one value."""
    n = len(w.hash) - k + 1
    values = rolled(w.hash, k, seed)
    ok = inside_one_text(w.first, k, n)
    doc = w.doc[: max(n, 0)][ok]
    values = values[ok] if n > 0 else values
    count = np.diff(w.first)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        extra = np.array([whole(w.hash[w.first[i] : w.first[i + 1]], k, seed) for i in short], np.uint64)
        values, doc = np.concatenate([values, extra]), np.concatenate([doc, short])
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    values, doc = values[keep], doc[keep]
    return values, np.searchsorted(doc, np.arange(len(w.first)))
