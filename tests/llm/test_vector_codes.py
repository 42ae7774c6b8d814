import hashlib
import math

import numpy as np

from quadrille.llm import vector_codes as vc
from quadrille.llm.queries import QUERIES

from .conftest import SF


def plain(rows, parts=4, entries=256, rounds=4):
    """rows: (vec_id, vector, label); distances of all pairs, in Python's integers where they might not fit."""
    usable = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    if not usable:
        return []
    usable.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    usable = [r for r in usable if len(r[1]) == len(usable[0][1])]
    x = np.array([[math.floor(1024 * float(v)) for v in r[1]] for r in usable], np.int64).reshape(len(usable), parts, -1)
    books = x[:entries].swapaxes(0, 1).copy()

    def assign():
        d = ((x[:, :, None, :] - books[None]) ** 2).sum(-1)
        return d.argmin(2), d.min(2)

    for _ in range(rounds):
        index, _ = assign()
        for p in range(parts):
            for e in range(books.shape[1]):
                mine = x[index[:, p] == e, p]
                if len(mine):
                    books[p, e] = [int(s) // len(mine) for s in mine.sum(0)]
    index, d = assign()
    digest = hashlib.sha256(",".join(map(str, books.ravel())).encode()).hexdigest()
    error = d.sum(1)
    totals = {}
    for r, e in zip(usable, error, strict=True):
        totals[r[2]] = totals.get(r[2], 0) + int(e)
    return sorted(map(repr, [(r[0], bytes(i.astype(np.uint8)).hex(), int(e), totals[r[2]], digest) for r, i, e in zip(usable, index, error, strict=True)]))


def result(df):
    return sorted(repr((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256)) for r in df.collect())


def make(spark, rows):
    return spark.createDataFrame([(i, v, k, "x") for i, v, k in rows], "vec_id long, embedding array<float>, label int, code string")


def floats(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], k) for i, v, k in rows]


def odd():
    r = np.random.default_rng(4)
    rows = [(int(i), r.normal(0, 1, 8).tolist(), [0, 1, None][i % 3]) for i in r.permutation(700)]
    rows += [(i, [0.25] * 8, 7) for i in range(60)] + [(5, [1e5] * 8, 1), (5, [-1e5, *[0.0] * 7], 1), (None, [0.5] * 8, None), (None, [0.5] * 8, 2)]
    return rows + [(900, None, 1), (901, [None] * 8, 1), (902, [float("nan"), *[0.0] * 7], 1), (903, [float("inf"), *[0.0] * 7], 0), (904, [], 1), (905, [0.0] * 12, 1)]


def test_equals_brute_force(spark):
    rows = floats(odd())
    assert result(vc.compress_vectors(make(spark, rows).repartition(5))) == plain(rows)


def test_fewer_rows_than_entries_and_other_parameters(spark):
    rows = floats(odd())[:40]
    assert result(vc.compress_vectors(make(spark, rows))) == plain(rows)
    assert result(vc.compress_vectors(make(spark, floats(odd())), parts=2, entries=16, rounds=1)) == plain(floats(odd()), 2, 16, 1)


def test_nothing_to_code_and_vectors_beyond_integers(spark):
    assert vc.compress_vectors(make(spark, [])).count() == 0
    assert vc.compress_vectors(make(spark, [(1, None, 1), (2, [0.0] * 6, 1), (3, [1e30] * 8, 1)])).count() == 0


def test_the_whole_table(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert result(QUERIES["op13_vector_code_compression"](spark, SF)) == plain(rows)


def test_the_tree_leaves_entries_out_and_decides_ties_by_index():
    r = np.random.default_rng(1)
    entries = r.integers(-4000, 4000, (256, 3))
    entries[100:120] = entries[7]
    x = np.concatenate([r.integers(-5000, 5000, (3000, 3)), entries, np.zeros((5, 3), np.int64)])
    tree = vc.BallTree(entries)
    index, best = tree.nearest(x)
    d = ((x[:, None] - entries[None]) ** 2).sum(-1)
    assert index.tolist() == d.argmin(1).tolist() and best.tolist() == d.min(1).tolist()
    assert tree.compared < d.size / 3
