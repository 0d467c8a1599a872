"""Lookups: outlines, directory trees, statistics, source slices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.scalars import ascii_lower, byte_slice


def file_outline(symbols: DataFrame, path: str) -> DataFrame:
    return symbols.where(F.col("path") == path).select("name", "qualified_name", "kind", "line", "end_line", "signature", F.substring(F.coalesce("docstring", F.lit("")), 1, 100).alias("docstring")).orderBy("line", "qualified_name")


def repo_outline(symbols: DataFrame, kind: str | None = None, limit: int = 200) -> DataFrame:
    kept = symbols.where(F.col("kind") == kind) if kind else symbols
    return kept.select("qualified_name", "kind", F.col("path").alias("file"), "line", "signature").orderBy("file", "line", "qualified_name").limit(K.clamp(1, limit, K.MAX_OUTLINE))


def below(files: DataFrame, prefix: str) -> DataFrame:
    """Files whose path begins with a prefix, ASCII case aside."""
    return files.where(F.like(ascii_lower(F.col("path")), ascii_lower(F.lit(prefix + "%")))) if prefix else files


def file_tree(files: DataFrame, symbols: DataFrame, prefix: str = "", depth: int = 3) -> DataFrame:
    """path, language, size_bytes, symbols (zero included) of files below a prefix, down to a depth."""
    near = below(files, prefix).where(F.size(F.split("path", "/")) <= depth + 1)
    n = symbols.groupBy("path").agg(F.count("*").alias("symbols"))
    return near.join(n, "path", "left").select("path", "language", "size_bytes", F.coalesce("symbols", F.lit(0)).cast("long").alias("symbols"))


def directory_rollup(files: DataFrame) -> DataFrame:
    """dir, files, bytes of each directory, all files below counted."""
    parts = F.split("path", "/")
    each = files.select("size_bytes", F.explode(F.sequence(F.lit(0), F.size(parts) - 1)).alias("k"), parts.alias("parts"))
    return each.select("size_bytes", F.array_join(F.slice("parts", 1, F.col("k")), "/").alias("dir")).groupBy("dir").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))


def repo_stats(files: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """metric, key, n: counts of files, symbols and edges, of resolved edges, by language and by kind."""
    row = lambda df, metric, key=None: (df.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n")) if key else df.agg(F.count("*").alias("n")).withColumn("key", F.lit(""))).select(F.lit(metric).alias("metric"), "key", "n")
    total = edges.agg(F.count("*").alias("call_edges"), F.count("callee_id").alias("resolved_edges"))
    out = row(files, "files").unionByName(row(symbols, "symbols"))
    out = out.unionByName(total.selectExpr("inline(array(struct('call_edges' AS metric, '' AS key, call_edges AS n), struct('resolved_edges' AS metric, '' AS key, resolved_edges AS n)))"))
    return out.unionByName(row(files.where(F.col("language").isNotNull()), "language", "language")).unionByName(row(symbols, "kind", "kind"))


def as_maps(stats: DataFrame) -> DataFrame:
    """metric, counts: the keyed rows of `repo_stats` as one map each, keys in order."""
    rows = F.array_sort(F.collect_list(F.struct("key", "n")))
    return stats.where("key <> ''").groupBy("metric").agg(F.map_from_entries(rows).alias("counts"))


def file_counts(dependencies: DataFrame) -> DataFrame:
    """file, depends_on_files, depended_by_files of a dependency map (file, direction, other)."""
    of = lambda way: F.count_distinct(F.when(F.col("direction") == way, F.col("other")))
    return dependencies.groupBy("file").agg(of("depends_on").alias("depends_on_files"), of("depended_by").alias("depended_by_files"))


def source(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """symbols with `source`: their byte range of the file's content as it was indexed."""
    return symbols.join(files.select("path", "content"), "path").withColumn("source", byte_slice(F.col("content"), F.col("byte_offset"), F.col("byte_length"))).drop("content")


def first_by_name(symbols: DataFrame, names: list[str]) -> DataFrame:
    """One row for each asked name, in order of asking and up to a cap; misses have an error."""
    asked = symbols.sparkSession.createDataFrame(list(enumerate(names[: K.MAX_BATCH])), "pos int, asked string")
    one = symbols.where(F.col("qualified_name").isin(*names[: K.MAX_BATCH])).withColumn("r", F.row_number().over(Window.partitionBy("qualified_name").orderBy("path", "line", "byte_offset"))).where("r = 1").drop("r")
    out = asked.join(one, asked["asked"] == one["qualified_name"], "left")
    return out.withColumn("error", F.when(F.col("qualified_name").isNull(), F.concat(F.lit("Symbol not found: "), "asked")))
