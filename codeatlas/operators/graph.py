"""Call-graph operators: traversal by levels, resolution, dependency map. Each level is a join; nothing is collected."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from .. import scratch
from ..functions.patterns import like_regex
from ..functions.scalars import ascii_lower, last_segment


#: Names up to this many are sent to every task; more are joined by a shuffle of as many partitions as the rows need.
MOST_SENT = 100_000


def callees(edges: DataFrame, names: DataFrame | None, start: str, depth: int = 1) -> DataFrame:
    """Edges met from `start`, each node expanded once, at its least depth.

    edges: caller, callee, line and more, which is carried; names: the names that exist, or None where edges have resolved_name.
    Rows: the edges' columns, resolved_name (null where the callee is no known name), depth. Repeated edges stay; unresolved
    ones are shown but not followed. The frontier meets the edges first; names are looked up for what it met only.
    """
    depth, columns = K.clamp(1, depth, K.MAX_DEPTH), [*[c for c in edges.columns if c != "resolved_name"], "resolved_name"]
    first = _one(edges.sparkSession, start)

    def step(frontier: DataFrame, level: int, table) -> tuple[DataFrame, DataFrame]:
        met = edges.join(frontier.select(F.col("name").alias("_at")), F.col("caller") == F.col("_at")).drop("_at")  # not as a semi-join, as in `suffix_match`
        if names is None:
            met = table(met, "met")
            return met, met.select(F.col("resolved_name").alias("name"))
        if level == 1:
            met = met.join(names, met["caller"] == names["name"], "left_semi")
        met = table(met, "met")
        known = table(names.join(met.select("callee").distinct(), F.col("name") == F.col("callee")).select("name").distinct(), "known")
        return met.join(known, met["callee"] == known["name"], "left").withColumnRenamed("name", "resolved_name"), known

    return _walk(first, depth, step, columns)


def callers(edges: DataFrame, start: str, depth: int = 1) -> DataFrame:
    """Edges that lead to `start` by textual callee name. edges: caller, callee, line and more, which is carried. Rows: the edges' columns, depth."""

    def step(frontier: DataFrame, level: int, table) -> tuple[DataFrame, DataFrame]:
        met = table(calls_of(edges, start) if level == 1 else suffix_match(edges, frontier), "met")
        return met, met.select(F.col("caller").alias("name"))

    return _walk(_one(edges.sparkSession, start), K.clamp(1, depth, K.MAX_DEPTH), step, edges.columns)


def callees_depth_first(edges: DataFrame, names: DataFrame | None, start: str, depth: int = 1) -> DataFrame:
    """Edges in the order and at the depths of a depth-first walk that expands each node once, where it first comes to it.

    As `callees`, with `place`, the walk's path to the edge as numbers, by which rows sort in the walk's order. Edges of a
    caller are taken by (line, callee, all else).

    A node's path is the least one that an expanded node's path and edge make, if it is shorter than `depth`: a node met first
    at the bottom hides its own edges from a shorter way that the walk tries later. Paths of all nodes are made from those of the
    round before until a round changes none; they are then the walk's, since a path depends on smaller ones only.
    """
    spark, at = edges.sparkSession, scratch.folder(edges.sparkSession)
    depth, carried = K.clamp(1, depth, K.MAX_DEPTH), [c for c in edges.columns if c != "resolved_name"]
    if names is not None:
        known = names.select(F.col("name").alias("resolved_name")).distinct()
        edges = edges.select(*carried).join(known, F.col("callee") == F.col("resolved_name"), "left")
    rest = [c for c in carried if c not in ("caller", "line", "callee")]
    order = Window.partitionBy("caller").orderBy("line", "callee", *rest)
    empty = F.array().cast("array<int>")
    paths = _one(spark, start).select("name", empty.alias("path"))
    if names is not None:
        paths = paths.join(known, F.col("name") == F.col("resolved_name"), "left_semi")
    paths, ball, known_to, k = scratch.save(paths, f"{at}-paths-0"), None, None, 0
    while True:
        k += 1
        # Edges of nodes that had a path in some round; those of new ones are looked up once.
        new = paths.select("name") if known_to is None else paths.select("name").join(known_to, "name", "left_anti")
        met = edges.join(new, edges["caller"] == new["name"], "left_semi")
        met = scratch.save(met.withColumn("nth", F.row_number().over(order)), f"{at}-edges-{k}")
        ball = met if ball is None else ball.unionByName(met)
        known_to = new if known_to is None else known_to.unionByName(new)
        here = ball.join(paths, ball["caller"] == paths["name"]).select(*ball.columns, F.concat("path", F.array("nth")).alias("place"))
        ways = here.where(F.col("resolved_name").isNotNull() & (F.size("place") < depth)).select(F.col("resolved_name").alias("name"), F.col("place").alias("path"))
        first = ways.unionByName(_one(spark, start).join(paths, "name", "left_semi").select("name", empty.alias("path")))
        fresh = scratch.save(first.groupBy("name").agg(F.min("path").alias("path")), f"{at}-paths-{k}")
        if not fresh.exceptAll(paths).limit(1).count() and not paths.exceptAll(fresh).limit(1).count():
            return here.select(*carried, "resolved_name", F.size("place").alias("depth"), "place")
        paths = fresh


def _one(spark, name: str) -> DataFrame:
    return spark.range(1).select(F.lit(name).alias("name"))


def _walk(frontier: DataFrame, depth: int, step, columns: list[str]) -> DataFrame:
    """What a level meets is written as a table, so that it is made once and the planner knows how large the next frontier can be. The last level is read by the caller only, and not written."""
    spark, seen, out = frontier.sparkSession, frontier, None
    at = scratch.folder(spark) if depth > 1 else ""
    for level in range(1, depth + 1):
        table = lambda df, name: scratch.save(df, f"{at}-{name}-{level}") if level < depth else df  # noqa: E731, B023
        met, names = step(frontier, level, table)
        rows = met.select(*columns, F.lit(level).alias("depth"))
        out = rows if out is None else out.unionByName(rows)
        if level < depth:
            frontier = table(names.where("name IS NOT NULL").distinct().join(seen, "name", "left_anti"), "frontier")
            seen = seen.unionByName(frontier)
    return out


def _segment(name: str) -> str:
    return name.rpartition(".")[2].translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def calls_of(edges: DataFrame, name: str) -> DataFrame:
    """Edges whose callee is `name`, or LIKE '%.' and its last segment: the same as `suffix_match` for one name."""
    segment, callee = _segment(name), F.col("callee")
    like = ascii_lower(callee).endswith(f".{segment}") if not set("_%") & set(segment) else callee.rlike(like_regex(f"%.{segment}"))
    return edges.where((callee == name) | like)


def suffix_match(edges: DataFrame, frontier: DataFrame) -> DataFrame:
    """Edges whose callee is a name of the frontier, or LIKE '%.' and the name's last segment (ASCII case aside). All by equi-joins.

    Segments without wildcards meet the callee's lower-case last segment. A live `_` takes any one character: what follows
    each dot of a callee is masked like each kind of segment of that length (its underscores' places) and then meets the
    segment itself. A live `%` takes any characters: candidates share three characters of a literal run and are tested.
    """
    f = frontier.select("name", ascii_lower(last_segment(F.col("name"))).alias("segment"))
    # A callee that is a name with a dot has the name's last segment, too; other names have to be looked up.
    odd = ~F.col("name").contains(".") | F.col("segment").rlike("[_%]")
    kinds = f.agg(F.count_if(F.col("segment").contains("%")).alias("any"), F.count_if(F.col("segment").contains("_")).alias("one"), F.count_if(odd).alias("odd"), F.count("*").alias("n")).first()
    plain = f.where(~F.col("segment").rlike("[_%]")).select("segment").distinct()
    e = edges.withColumn("tail", F.when(F.col("callee").contains("."), ascii_lower(last_segment(F.col("callee")))))
    if kinds["n"] <= MOST_SENT:
        plain = F.broadcast(plain)
    else:
        e = e.repartition(scratch.partitions(edges.sparkSession, edges.count()), "tail")
    if not kinds["odd"]:
        # Segments differ, so this is a semi-join; one by name would be pushed into each branch of a union, whose sorts one task may then hold together.
        return e.join(plain, F.col("tail") == F.col("segment")).select(*edges.columns)
    by_name = f.where(odd).select("name").distinct().withColumn("is_name", F.lit(True))
    tried = e.join(plain.withColumn("is_tail", F.lit(True)), F.col("tail") == F.col("segment"), "left").join(by_name, F.col("callee") == F.col("name"), "left")
    tried = tried.select(*edges.columns, (F.col("is_name").isNotNull() | F.col("is_tail").isNotNull()).alias("met"))
    out = tried.where("met")
    if kinds["any"] or kinds["one"]:
        texts = tried.where("NOT met AND contains(callee, '.')").select("callee", ascii_lower(F.col("callee")).alias("low")).distinct()
        hit = texts.select("callee").limit(0)
        if kinds["one"]:
            hit = hit.unionByName(_one_character(texts, f.where("contains(segment, '_') AND NOT contains(segment, '%')").select("segment").distinct()))
        if kinds["any"]:
            hit = hit.unionByName(_any_characters(texts, f.where("contains(segment, '%')").select("segment").distinct()))
        out = out.unionByName(tried.where("NOT met").join(hit.distinct(), "callee", "left_semi").select(*tried.columns))
    return out.drop("met")


def _one_character(texts: DataFrame, wild: DataFrame) -> DataFrame:
    tails = texts.select("callee", F.explode(F.expr("transform(sequence(1, size(split(low, '[.]')) - 1), k -> substring_index(low, '.', -k))")).alias("tail"))
    mask = F.regexp_replace("segment", "(?s)[^_]", "x")
    masks = wild.select(mask.alias("mask")).distinct()
    masked = F.expr("array_join(transform(sequence(1, length(mask)), i -> if(substring(mask, i, 1) = '_', '_', substring(tail, i, 1))), '')")
    tried = tails.join(masks, F.length("tail") == F.length("mask")).select("callee", "mask", masked.alias("masked"))
    kinds = wild.select(mask.alias("of"), "segment")
    return tried.join(kinds, (F.col("mask") == F.col("of")) & (F.col("masked") == F.col("segment")), "left_semi").select("callee")


def _any_characters(texts: DataFrame, wild: DataFrame) -> DataFrame:
    key = F.regexp_extract("segment", "(?s)[^_%]{3}|[^_%]{2}|[^_%]", 0)
    keyed = wild.select("segment", key.alias("key"))
    grams = F.array_distinct(F.expr("flatten(transform(sequence(1, 3), n -> transform(sequence(1, greatest(length(low) - n + 1, 1)), i -> substring(low, i, n))))"))
    pattern = F.concat(F.lit("%."), "segment")
    met = texts.select("callee", "low", F.explode(grams).alias("key")).join(keyed.where("key <> ''"), "key").where(F.like("low", pattern, F.lit("\0")))
    # Without a literal character, a segment asks for a dot and as many characters after it as it has underscores; the least one decides.
    least = keyed.where("key = ''").agg(F.min(F.length(F.replace("segment", F.lit("%"), F.lit("")))).alias("least"))
    loose = texts.withColumn("one", F.lit(1)).join(F.broadcast(least.withColumn("one", F.lit(1))), "one").where("length(low) - instr(low, '.') >= least")
    return met.select("callee").unionByName(loose.select("callee"))


def with_definitions(rows: DataFrame, symbols: DataFrame, key: str, prefix: str) -> DataFrame:
    """rows (read twice) with kind, <prefix>_line and <prefix>_file of the first symbol (by path, line) of the name in `key`; null where there is none.

    symbols: qualified_name, kind, line, path. Looked up for the names in rows only.
    """
    spark = rows.sparkSession
    rows = scratch.save(rows, scratch.folder(spark))
    asked = rows.select(F.col(key).alias("asked")).distinct()
    if rows.count() <= MOST_SENT:
        asked = F.broadcast(asked)
    else:
        symbols = symbols.repartition(scratch.partitions(spark, symbols.count()), "qualified_name")
    found = symbols.join(asked, F.col("qualified_name") == F.col("asked")).drop("asked")  # not as a semi-join, as in `suffix_match`
    first = found.groupBy(F.col("qualified_name").alias("asked")).agg(F.min(F.struct("path", "line", "kind")).alias("d"))
    joined = rows.join(first, rows[key] == first["asked"], "left")
    return joined.select(*rows.columns, F.col("d.kind").alias("kind"), F.col("d.line").alias(f"{prefix}_line"), F.col("d.path").alias(f"{prefix}_file"))


def resolve(edges: DataFrame, symbols: DataFrame, order: Column) -> DataFrame:
    """edges with callee_id filled where it is null: the least symbol (by `order`) whose name or qualified_name is the callee."""
    names = symbols.select(F.col("name").alias("key"), order.alias("o"), "id").unionByName(symbols.select(F.col("qualified_name").alias("key"), order.alias("o"), "id"))
    first = names.groupBy("key").agg(F.min_by("id", F.struct("o", "id")).alias("found"))
    joined = edges.join(first, edges["callee"] == first["key"], "left")
    return joined.withColumn("callee_id", F.coalesce("callee_id", "found")).drop("key", "found")


def dependency_map(edges: DataFrame) -> DataFrame:
    """Both directions of file-to-file calls: file, direction, other, names (distinct, in first-seen order).

    edges: caller_file, callee_file, caller, callee, pos.
    """
    cross = edges.where(F.col("callee_file").isNotNull() & (F.col("caller_file") != F.col("callee_file")))
    out = cross.select(F.col("caller_file").alias("file"), F.lit("depends_on").alias("direction"), F.col("callee_file").alias("other"), F.col("callee").alias("name"), "pos")
    back = cross.select(F.col("callee_file").alias("file"), F.lit("depended_by").alias("direction"), F.col("caller_file").alias("other"), F.col("caller").alias("name"), "pos")
    first = out.unionByName(back).groupBy("file", "direction", "other", "name").agg(F.min("pos").alias("pos"))
    return first.groupBy("file", "direction", "other").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("names"))
