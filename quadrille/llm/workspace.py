"""Durable cuts of lineage, and joins that no single key holds up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cuts import shared_folder

SHARE = 256  # a key is hot if it has more than one row in so many; there are fewer hot keys than that
WAYS = 64  # parts that the rows of a hot key are dealt to


def durable(df: DataFrame) -> DataFrame:
    """df, written to spark.checkpoint.dir and read from there.

    Where the session names no folder, a local session has one in its warehouse; any
    other is refused, as a folder of one machine would not do.
    """
    spark = SparkSession.builder.getOrCreate()
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or shared_folder(spark) + "/_checkpoints")
    return df.checkpoint(eager=True)


def spread_join(many: DataFrame, one: DataFrame, on: list[str], counts: DataFrame, how: str = "inner", part: list[str] | None = None) -> DataFrame:
    """many joined with one, whose keys are unique; rows of hot keys are dealt over WAYS tasks and meet a copy of the key's row in each.

    counts: the columns of on, and n, the rows of many that have them. Hot keys
    are fewer than SHARE whatever the input, so their list is sent to all tasks.
    part: columns that tell rows of a key apart; all by default.
    """
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = counts.where((F.col("n") * SHARE > total) & (F.col("n") > 8 * WAYS)).select(*on).collect()
    if not rows:
        return many.join(one, on, how)
    hot = F.broadcast(many.sparkSession.createDataFrame(rows, counts.select(*on).schema).withColumn("_hot", F.lit(True)))
    dealt = F.pmod(F.xxhash64(F.lit(29), *(part or [c for c in many.columns if c not in on])), F.lit(WAYS)).cast("int")
    left = many.join(hot, on, "left").withColumn("_part", F.when(F.col("_hot"), dealt).otherwise(F.lit(0))).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(WAYS - 1))).otherwise(F.array(F.lit(0)))
    right = one.join(hot, on, "left").withColumn("_part", F.explode(copies)).drop("_hot")
    return left.join(right, [*on, "_part"], how).drop("_part")
