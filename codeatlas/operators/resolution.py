"""Resolution of calls by name, kept up to date by what changed.

A name index holds every key (a symbol's name or qualified name) with the symbol that it may stand for; the first by (path,
line, byte offset) is the key's winner. After a change only keys of symbols that came or went can have another winner, and
only calls of such keys are resolved again. Symbols' ids don't depend on where in its file a symbol stands, so that moved
lines change no call.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOUND = ["callee_id", "resolved_name", "callee_kind", "def_file"]


def with_ids(symbols: DataFrame, salt: Column) -> DataFrame:
    """symbols with an id made of path, kind, qualified name and the place among those that share them."""
    place = F.row_number().over(Window.partitionBy("path", "kind", "qualified_name").orderBy("byte_offset"))
    return symbols.withColumn("id", F.xxhash64(salt, "path", "kind", "qualified_name", place))


def name_index(symbols: DataFrame) -> DataFrame:
    """key, path, line, byte_offset, id, qualified_name, kind: a row for each of a symbol's names."""
    rest = ["path", "line", "byte_offset", "id", "qualified_name", "kind"]
    whole = symbols.select(F.col("qualified_name").alias("key"), *rest)
    return whole.unionByName(symbols.where("name <> qualified_name").select(F.col("name").alias("key"), *rest))


def winners(names: DataFrame) -> DataFrame:
    """key, callee_id, resolved_name, callee_kind, def_file."""
    first = names.groupBy("key").agg(F.min(F.struct("path", "line", "byte_offset", "id", "qualified_name", "kind")).alias("w"))
    return first.select("key", F.col("w.id").alias("callee_id"), F.col("w.qualified_name").alias("resolved_name"), F.col("w.kind").alias("callee_kind"), F.col("w.path").alias("def_file"))


def calls_of(symbols: DataFrame) -> DataFrame:
    """A row for each call: caller_id, path, caller, caller_kind, caller_line, pos, callee, line, and local_id, the file's own symbol of that qualified name."""
    calls = symbols.select(F.col("id").alias("caller_id"), "path", F.col("qualified_name").alias("caller"), F.col("kind").alias("caller_kind"), F.col("line").alias("caller_line"), F.posexplode("calls").alias("pos", "c"))
    calls = calls.select("caller_id", "path", "caller", "caller_kind", "caller_line", "pos", F.col("c.callee_name").alias("callee"), F.col("c.line").alias("line"))
    local = symbols.groupBy("path", F.col("qualified_name").alias("callee")).agg(F.min(F.struct("line", "byte_offset", "id", "kind")).alias("l"))
    own = local.select("path", "callee", F.col("l.id").alias("local_id"), F.col("l.kind").alias("local_kind"))
    return calls.join(own, ["path", "callee"], "left")


def resolve(calls: DataFrame, found: DataFrame) -> DataFrame:
    """calls with FOUND: the file's own symbol if there is one, else the winner of the callee's name."""
    base = [c for c in calls.columns if c not in FOUND]
    is_local = F.col("local_id").isNotNull()
    joined = calls.select(*base).join(found, F.col("callee") == F.col("key"), "left")
    return joined.select(
        *base, F.coalesce("local_id", "callee_id").alias("callee_id"), F.when(is_local, F.col("callee")).otherwise(F.col("resolved_name")).alias("resolved_name"),
        F.when(is_local, F.col("local_kind")).otherwise(F.col("callee_kind")).alias("callee_kind"), F.when(is_local, F.col("path")).otherwise(F.col("def_file")).alias("def_file"),
    )


def changed_keys(before: DataFrame, after: DataFrame) -> DataFrame:
    """key of what has another winner than before, one that appeared, or none any more."""
    b, a = before.select("key", F.col("callee_id").alias("was")), after.select("key", F.col("callee_id").alias("now"))
    return b.join(a, "key", "full_outer").where(~F.col("was").eqNullSafe(F.col("now"))).select("key")


def update(edges: DataFrame, names: DataFrame, dead: DataFrame, symbols: DataFrame, save) -> tuple[DataFrame, DataFrame]:
    """(new edges, calls of earlier runs that they replace: caller_id, pos).

    edges, names: resolved calls and name index before the change; dead: path of files that changed or went; symbols: those of
    new and changed files; save: writes a scratch table. Work beyond the change: the edges and names of the keys that it touches.
    """
    come = save(name_index(symbols), "come")
    touched = save(names.join(dead, "path", "left_semi").select("key").unionByName(come.select("key")).distinct(), "touched")
    calls = calls_of(symbols)
    asked = touched.unionByName(calls.select(F.col("callee").alias("key"))).distinct()
    held = save(names.select(*come.columns).join(asked, "key", "left_semi"), "held")
    after = save(winners(held.join(dead, "path", "left_anti").unionByName(come.join(asked, "key", "left_semi"))), "after")
    changed = changed_keys(winners(held.join(touched, "key", "left_semi")), after.join(touched, "key", "left_semi"))
    again = edges.where("local_id IS NULL").join(changed, F.col("callee") == F.col("key"), "left_semi").join(dead, "path", "left_anti")
    again = save(again.select(*calls.columns), "again")
    return resolve(calls.unionByName(again), after), again.select("caller_id", "pos")
