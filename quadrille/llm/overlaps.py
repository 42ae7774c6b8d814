"""Overlap counts of a block of a sparse row by column matrix with itself.

Columns that two rows or more share are multiplied: those of few rows pair by
pair, the others as dense slabs of bounded width. What accumulates is a matrix
of counts, rows times rows, whatever the columns.
"""

from __future__ import annotations

import numpy as np

SLAB = 1 << 21  # cells of a dense slab
FEW = 10  # rows of a column that is multiplied pair by pair


def overlaps(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """n by n: how many values each two different rows share; each row has a value once. The diagonal means nothing."""
    order = np.argsort(values, kind="stable")
    values, row = values[order], row[order].astype(np.int64)
    start = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.empty(0, np.int64)
    size = np.diff(np.append(start, len(values)))
    out = np.zeros(n * n, np.int64)
    for d in range(2, FEW + 1):
        at = start[size == d]
        if len(at):
            pairs = [row[at + a] * n + row[at + b] for a in range(d) for b in range(a + 1, d)]
            out += np.bincount(np.concatenate(pairs), minlength=n * n)
    out = out.reshape(n, n)
    out = out + out.T
    start, size = start[size > FEW], size[size > FEW]
    width = max(1, SLAB // max(n, 1))
    for low in range(0, len(start), width):
        at, count = start[low : low + width], size[low : low + width]
        column = np.repeat(np.arange(len(at)), count)
        entry = np.repeat(at, count) + np.arange(len(column)) - np.repeat(np.cumsum(count) - count, count)
        slab = np.zeros((n, len(at)), np.float32)
        slab[row[entry], column] = 1
        out += (slab @ slab.T).astype(np.int64)
    return out
