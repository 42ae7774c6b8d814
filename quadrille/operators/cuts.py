"""Durable cuts of lineage: tables in the folder that the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors see. Where it is unset, a local session has the warehouse's folder; any other is refused, as a folder of one machine would not do."""
    folder = spark.sparkContext.getCheckpointDir() or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (folder or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def durable(df: DataFrame, *by: str) -> DataFrame:
    """df, written and read again: what is computed once survives the loss of executors, and may be given back with discard(). by: numbers that have a folder each."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.cut_path = path
    return found


def discard(df: DataFrame | None) -> None:
    """Deletes the table of a cut that no later plan reads."""
    path = getattr(df, "cut_path", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
