"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, deleted at the latest when the driver ends.

    Where the setting is missing, a local master gets a temporary folder; a cluster has to name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="codeatlas-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def at(spark: SparkSession, path: str):
    """A path and its file system."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def save(df: DataFrame, path: str) -> DataFrame:
    """Write a table and read it again: cuts the lineage, so a lost executor costs no earlier step."""
    df.write.mode("overwrite").parquet(path)
    at_exit(df.sparkSession, path)  # what is still read when the caller returns
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession, rows: int, each: int = 500_000) -> int:
    """Partitions of a shuffle of so many rows: the session's, or more where a task would get more than `each` rows to sort."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def by_range(df: DataFrame, rows: int, order: Sequence[str]) -> DataFrame:
    """Dealt and sorted by ranges, in more partitions than the session's where `rows` need them."""
    n = partitions(df.sparkSession, rows)
    more = n > partitions(df.sparkSession, 0)
    return (df.repartitionByRange(n, *order) if more else df.repartitionByRange(*order)).sortWithinPartitions(*order)


def at_exit(spark: SparkSession, path: str) -> None:
    """Delete `path` when the driver ends."""
    fs, there = at(spark, path)
    fs.deleteOnExit(there)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that no later step reads."""
    for path in paths:
        fs, there = at(spark, path)
        fs.delete(there, True)
