import zlib

import numpy as np

from quadrille.llm import sharding


def plain(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_follows_the_published_loop():
    keys = np.random.default_rng(0).integers(0, 2**63, 2000).astype(np.uint64)
    for n in (1, 2, 16, 17, 1000):
        assert [plain(int(k), n) for k in keys] == list(sharding.jump_hash(keys, n))


def mixed(i):
    x = (i % 2**64 + 0x9E3779B97F4A7C15) % 2**64
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> shift) * factor % 2**64
    return x ^ x >> 31


def test_shards_of_the_whole_table_follow_the_published_loop(spark):
    rows = sharding.assign_shards(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    assert len({r.shard for r in rows}) == 16
    assert all((r.shard, r.grown_shard) == (plain(mixed(r.doc_id), 16), plain(mixed(r.doc_id), 17)) for r in rows)


def test_growth_moves_rows_into_the_new_shard_only(make_docs, messy):
    rows = sharding.assign_shards(make_docs([*messy, *messy[:20], (None, "a"), (None, None)])).collect()
    assert len(rows) == len(messy) + 22
    for r in rows:
        assert r.grown_shard in (r.shard, 16) and r.law == "key"
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    text = dict(messy)
    for r in rows:
        if r.doc_id is not None:
            raw = (text[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    assert len({r.shard for r in rows if r.doc_id is None}) == 1


def test_shares_are_even_and_no_rows_give_none(spark, make_docs):
    big = spark.range(8000).selectExpr("id doc_id", "string(id) text", "1 shard", "2 slot")
    counts = [r["count"] for r in sharding.assign_shards(big).groupBy("shard").count().collect()]
    assert len(counts) == 16 and max(counts) < 620 and min(counts) > 380
    assert sharding.assign_shards(make_docs([])).count() == 0
