"""Snapshots: status by hash, upsert and delete with their cascades, and differences of symbols."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def file_status(old: DataFrame, new: DataFrame, unread: bool = False) -> DataFrame:
    """path, status (new, changed, deleted, unchanged) of two tables (path, sha256); with `unread`, files in `new` without a hash are unchanged or, if they are new, unread; `blank` tells them."""
    o, n = old.select("path", F.col("sha256").alias("was")), new.select("path", F.col("sha256").alias("now"), F.col("sha256").isNull().alias("blank"))
    status = F.when(F.coalesce("blank", F.lit(False)), F.when(F.col("was").isNull(), "unread").otherwise("unchanged")) if unread else F
    status = status.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("was") != F.col("now"), "changed").otherwise("unchanged")
    return o.join(n, "path", "full_outer").select("path", status.alias("status"), *([F.coalesce("blank", F.lit(False)).alias("blank")] if unread else []))


def counters(status: DataFrame) -> DataFrame:
    """One row of counts, as an indexing run reports them."""
    is_ = lambda *s: F.count_if(F.col("status").isin(*s))
    return status.agg(is_("new", "changed", "unchanged").alias("total_files"), is_("new", "changed").alias("indexed"), is_("unchanged").alias("skipped_unchanged"), is_("deleted").alias("deleted"))


def upsert(old: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """Rows of `new` replace those of `old` with the same key."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def delete(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return table.join(gone.select(key).distinct(), key, "left_anti").select(*table.columns)


def cascade(symbols: DataFrame, edges: DataFrame, vectors: DataFrame | None, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Symbols, edges and vectors without the files in `gone` (file_id): edges of a gone caller go, those to a gone callee lose callee_id."""
    kept = delete(symbols, gone, "file_id")
    ids = kept.select("id")
    of_caller = edges.join(ids, edges["caller_id"] == ids["id"], "left_semi")
    callee = kept.select(F.col("id").alias("there"))
    cut = of_caller.join(callee, of_caller["callee_id"] == callee["there"], "left").withColumn("callee_id", F.col("there")).drop("there").select(*edges.columns)
    return kept, cut, None if vectors is None else vectors.join(ids, vectors["symbol_id"] == ids["id"], "left_semi")


def diff_symbols(old: DataFrame, new: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """qualified_name, status (added, removed, modified), old and new line and signature. Modified: another line or signature.

    Tables: qualified_name, line, signature, path. Of several rows with a name, the last by (path, line) counts. `carry`: more
    columns, as they are now, or were for removed symbols.
    """
    last = lambda df, tag: df.groupBy("qualified_name").agg(F.max_by(F.struct("line", "signature", *carry), F.struct("path", "line")).alias(tag))
    both = last(old, "o").join(last(new, "n"), "qualified_name", "full_outer")
    moved = ~(F.col("o.line").eqNullSafe(F.col("n.line")) & F.col("o.signature").eqNullSafe(F.col("n.signature")))
    status = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(moved, "modified")
    more = [F.when(F.col("n").isNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in carry]
    out = both.select("qualified_name", status.alias("status"), *more, F.col("o.line").alias("old_line"), F.col("n.line").alias("new_line"), F.col("o.signature").alias("old_signature"), F.col("n.signature").alias("new_signature"))
    return out.where(F.col("status").isNotNull())
