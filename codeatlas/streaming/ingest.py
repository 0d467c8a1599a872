"""Streaming ingest: each micro-batch of files becomes a snapshot update."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from .. import scratch
from ..operators import snapshot
from ..operators.segments import Segments


def latest(batch: DataFrame) -> DataFrame:
    """One row for each path of a batch: the last by modificationTime, then by hash."""
    return batch.groupBy("path").agg(F.max_by(F.struct(*[c for c in batch.columns if c != "path"]), F.struct("modificationTime", "sha256")).alias("r")).select("path", "r.*")


def upsert_stream(files: DataFrame, table: str) -> DataStreamWriter:
    """Writer that keeps `table` (a folder of versions) at the latest row of each path. files: path, sha256, modificationTime and more.

    Version k holds all batches up to k, so a batch that is run again writes the same version.
    """

    def step(batch: DataFrame, k: int) -> None:
        spark = batch.sparkSession
        new = latest(batch)
        out = new if k == 0 else snapshot.upsert(spark.read.parquet(f"{table}/v{k - 1}"), new)
        out.write.mode("overwrite").parquet(f"{table}/v{k}")

    return files.writeStream.foreachBatch(step)


def _state(spark: SparkSession, table: str, before: int | None = None) -> dict | None:
    """What the newest batch, or the newest before a number, has published."""
    fs, at = scratch.at(spark, f"{table}/state")
    names = sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []
    names = [n for n in names if n.isdigit() and (before is None or int(n) < before)]
    return json.loads(spark.read.text(f"{table}/state/{names[-1]}", wholetext=True).first()[0]) if names else None


def merge_stream(files: DataFrame, table: str) -> DataStreamWriter:
    """Writer that keeps the latest row of each path in `table`, each batch writing its own rows only (segments and tombstones). files: path, sha256, modificationTime and more.

    The last writer by (modificationTime, sha256) wins, so a late row changes nothing. A batch that is run again starts from
    what the batch before it published, writes to the same folder afresh, and publishes the same.
    """

    def step(batch: DataFrame, k: int) -> None:
        spark = batch.sparkSession
        state = _state(spark, table, k)
        scratch.remove(spark, f"{table}/b{k:09d}", f"{table}/m{k:09d}")
        old, held = Segments(spark, table, state), Segments(spark, table, state, f"b{k:09d}")
        new = scratch.save(latest(batch), f"{table}/b{k:09d}/batch")
        if state:
            before = old.live("rows").join(new.select("path"), "path", "left_semi").select("path", F.struct("modificationTime", "sha256").alias("was"))
            both = new.join(before, "path", "left")
            new = scratch.save(both.where("was IS NULL OR struct(modificationTime, sha256) > was"), f"{table}/b{k:09d}/won")
            held.bury("dead_paths", new.where("was IS NOT NULL"), True)
            new = new.drop("was")
        held.add("rows", new, ["path"])
        scratch.remove(spark, f"{table}/b{k:09d}/batch", f"{table}/b{k:09d}/won")
        held = held.merge("rows", f"m{k:09d}") or held
        fs, at = scratch.at(spark, f"{table}/state/{k:09d}")
        out = fs.create(at, True)
        out.write(bytearray(json.dumps(held.state).encode()))
        out.close()

    return files.writeStream.foreachBatch(step)


def current(spark: SparkSession, table: str) -> DataFrame:
    """The latest row of each path."""
    return Segments(spark, table, _state(spark, table)).live("rows").drop("gen")
