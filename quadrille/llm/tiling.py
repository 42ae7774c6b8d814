"""Greedy string tiling (Wise, 1993) of two sequences of word hashes, in bounded memory.

Maximal matches are enumerated where they begin: a seed pair whose words before
differ. Seeds of the item are grouped by hash and, inside, by the word before,
so a place of the document skips the whole subgroup with its own word before;
what is enumerated is the matches themselves, not the pairs of equal seeds - two
long runs of one word have a match for each diagonal, not for each pair of
places. How far a match goes follows from Karp-Rabin hashes of prefixes.

Texts of few different words have many short matches, of which the long ones
leave little room. So where more than FEW matches begin, seeds of SEARCHES times
the least length go first: what they mark is gone when shorter ones are looked
for. The tiles are the same, as all longer matches come before shorter ones.

At most LIMIT matches are held. If there are more, the best are marked first,
and the rest is enumerated anew among the words that are still unmarked.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

from .textgrid import mix, rolled

LIMIT = 200_000
PAIRS = 1 << 20  # matches looked at at once
FEW = 1 << 12  # matches that are enumerated without looking for longer ones first
SEARCHES = (16, 8, 4, 3, 2)  # of the least length, searched before it
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MARK_A, _MARK_B = np.uint64(0x6A09E667F3BCC909), np.uint64(0xBB67AE8584CAA73B)


def _prefixes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    power = np.full(len(x) + 1, _STEP)
    power[0] = 1
    power = np.multiply.accumulate(power)
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(mix(x) * power[:-1], out=total[1:])
    return total, power


def _lengths(i: np.ndarray, j: np.ndarray, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], least: int) -> np.ndarray:
    """How many values from i and j on are equal, least at least, by bisection."""
    (sum_a, power_a), (sum_b, power_b) = a, b
    low = np.full(len(i), least)
    high = np.minimum(len(sum_a) - 1 - i, len(sum_b) - 1 - j)
    while (low < high).any():
        middle = (low + high + 1) >> 1
        same = (sum_a[i + middle] - sum_a[i]) * power_b[j] == (sum_b[j + middle] - sum_b[j]) * power_a[i]
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


def _best(i: np.ndarray, j: np.ndarray, n: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((j, i, -n))[:most]
    return i[order], j[order], n[order]


@dataclass
class Begins:
    """Where maximal matches begin: place j[x] of b with count[x] of the places order[low[x]:] of a, but for skipped[x] of them at skip[x]."""

    order: np.ndarray
    j: np.ndarray
    low: np.ndarray
    skip: np.ndarray
    skipped: np.ndarray
    count: np.ndarray


def begins(a: np.ndarray, b: np.ndarray, least: int) -> Begins:
    """The begins of all matches of least values or more; their number is known before they are enumerated."""
    seed_a, seed_b = rolled(a, least), rolled(b, least)
    if not len(seed_a) or not len(seed_b):
        return Begins(*(np.empty(0, np.int64) for _ in range(6)))
    before_a, before_b = np.append(_MARK_A, a[: len(seed_a) - 1]), np.append(_MARK_B, b[: len(seed_b) - 1])
    both_a, both_b = mix(seed_a ^ mix(before_a)), mix(seed_b ^ mix(before_b))
    order = np.lexsort((both_a, seed_a))
    seed_a, both_a = seed_a[order], both_a[order]
    j = np.flatnonzero(seed_a[np.minimum(np.searchsorted(seed_a, seed_b), len(seed_a) - 1)] == seed_b)
    low, high = np.searchsorted(seed_a, seed_b[j], "left"), np.searchsorted(seed_a, seed_b[j], "right")
    # the subgroup with the same word before, at [skip, skip + skipped) of the order
    starts = np.flatnonzero(np.append(True, both_a[1:] != both_a[:-1]))
    by_both = starts[np.argsort(both_a[starts])]
    sizes = np.diff(np.append(starts, len(both_a)))[np.argsort(both_a[starts])]
    at = np.minimum(np.searchsorted(both_a[by_both], both_b[j]), len(by_both) - 1)
    same = both_a[by_both[at]] == both_b[j]
    skip, skipped = np.where(same, by_both[at], low), np.where(same, sizes[at], 0)
    return Begins(order, j, low, skip, skipped, high - low - skipped)


def matches(a: np.ndarray, b: np.ndarray, least: int, limit: int, found: Begins) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Maximal matches (place in a, place in b, length): the limit longest, first ones on ties, and whether there are more."""
    none = np.empty(0, np.int64)
    prefix_a, prefix_b = _prefixes(a), _prefixes(b)
    kept, more = (none, none, none), False
    ends = np.cumsum(found.count)
    first = 0
    while first < len(found.j):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PAIRS, "right")))
        s = slice(first, last)
        c = found.count[s]
        nth = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        place = np.repeat(found.low[s], c) + nth
        place += np.where(place >= np.repeat(found.skip[s], c), np.repeat(found.skipped[s], c), 0)
        i, here = found.order[place], np.repeat(found.j[s], c)
        kept = tuple(np.concatenate(x) for x in zip(kept, (i, here, _lengths(i, here, prefix_a, prefix_b, least)), strict=True))
        if len(kept[0]) > limit:
            kept, more = _best(*kept, limit), True
        first = last
    return *kept, more


def tiles(item: np.ndarray, document: np.ndarray, least: int, limit: int = LIMIT) -> list[tuple[int, int, int]]:
    """Tiles (place in item, place in document, length): the longest match of unmarked words is marked again and again, the first in item and document on ties."""
    a, b, out = item.copy(), document.copy(), []
    mine, theirs = np.zeros(len(a), bool), np.zeros(len(b), bool)
    found = begins(a, b, least)
    if found.count.sum() > FEW:
        for n in SEARCHES:
            _mark(a, b, mine, theirs, n * least, limit, begins(a, b, n * least), out)
        found = begins(a, b, least)
    _mark(a, b, mine, theirs, least, limit, found, out)
    return out


def _mark(a: np.ndarray, b: np.ndarray, mine: np.ndarray, theirs: np.ndarray, least: int, limit: int, found: Begins, out: list[tuple[int, int, int]]) -> None:
    """Marks, in mine and theirs, all matches of least words or more; marked words of a and b become words that stand nowhere else."""
    again = True
    while again:
        i, j, n, more = matches(a, b, least, limit, found)
        heap = list(zip((-n).tolist(), i.tolist(), j.tolist(), strict=True))
        heapq.heapify(heap)
        worst = max(heap) if more else None  # beyond it, matches that are not held may come first
        again = more
        while heap:
            n, i, j = heapq.heappop(heap)
            if worst is not None and (n, i, j) > worst:
                continue
            n = -n
            taken = mine[i : i + n] | theirs[j : j + n]
            if not taken.any():
                mine[i : i + n] = theirs[j : j + n] = True
                out.append((i, j, n))
                continue
            edge = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]]).astype(np.int8)))
            for start, end in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                if end - start >= least:
                    heapq.heappush(heap, (start - end, i + start, j + start))
        a[mine], b[theirs] = mix(np.flatnonzero(mine).astype(np.uint64) + _MARK_A), mix(np.flatnonzero(theirs).astype(np.uint64) + _MARK_B)
        if again:
            again = not mine.all() and not theirs.all()
            found = begins(a, b, least)
