"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A shard follows from the stable key and the number of shards alone; no ring
table exists. Appending a shard moves about 1/(n+1) of the keys, all into the
new one. Slots number the rows of a shard without gaps: rows are counted by
(shard, bucket), the counts of the fixed number of buckets become offsets, and
rows are numbered only inside a bucket, so no task holds a whole shard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textgrid import mix

SHARDS = 16
BUCKETS = 2048  # per shard; bounds the broadcast offsets at SHARDS * BUCKETS rows


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unsigned 64-bit key: all keys jump together until each lands beyond the last shard."""
    if shards < 1:
        raise ValueError("shards must be positive")
    state = keys.astype(np.uint64, copy=True)
    out = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    ahead = np.zeros(len(state), np.int64)
    while len(live):
        out[live] = ahead
        moving = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        state[live] = moving
        jump = (out[live] + 1).astype(np.float64) * (float(1 << 31) / ((moving >> np.uint64(33)).astype(np.float64) + 1.0))
        ahead = np.minimum(jump, 2.0**62).astype(np.int64)
        stay = ahead < shards
        live, ahead = live[stay], ahead[stay]
    return out


def _spread(ids: pa.Array) -> np.ndarray:
    """Keys must look random: mixed ids; null gets a key of its own."""
    values = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    keys = mix(values + np.uint64(0x9E3779B97F4A7C15))
    if ids.null_count:
        keys[ids.is_null().to_numpy(zero_copy_only=False)] = np.uint64(0x243F6A8885A308D3)
    return keys


def assign_shards(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs.

    Null text has size 1 and CRC 0. Rows with a null key share a shard, and are
    spread over its buckets by their text. Repeated rows are rows like others and
    get slots of their own. An empty table gives no rows; other columns are not read.
    """
    narrow = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(text)), F.lit(0)).cast("long").alias("text_crc32"),
    )

    def place(batches):
        for batch in batches:
            keys = _spread(batch.column("doc_id"))
            crc = batch.column("text_crc32").to_numpy(zero_copy_only=False).astype(np.uint64)
            bucket = mix(keys ^ (crc << np.uint64(17))) % np.uint64(buckets)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(jump_hash(keys, shards), pa.int32()), pa.array(jump_hash(keys, shards + 1), pa.int32()), pa.array(bucket.astype(np.int32))],
                names=["doc_id", "size", "text_crc32", "shard", "grown_shard", "bucket"],
            )

    placed = narrow.mapInArrow(place, "doc_id long, size long, text_crc32 long, shard int, grown_shard int, bucket int")
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    numbered = placed.withColumn("at", F.row_number().over(inside) - 1)
    # at most shards * buckets rows, whatever the input
    return numbered.join(F.broadcast(offsets), ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("at")).cast("long").alias("slot"), "grown_shard"
    )
