"""Chat formatting with cumulative-snapshot collapse.

Logged conversations that are prefixes of longer ones (and copies) go; the maximal ones are rendered. A conversation is its
turns in order of (turn, role, text). A turn's hash covers its place, role and text; the rolling hash of a prefix is the
exclusive or of its turns' (two hashes of 64 bits each), which a running window gives in one pass, so that work is linear in
the turns but for their sorting. A conversation goes if its last hash is among those that longer ones pass through; of equal conversations the one with
the smallest conv_id stays.

Null roles or texts count as empty strings in rendering but differ from them in hashes; a null turn sorts first; rows
without conv_id make up one conversation of their own. Repeated rows are turns of their own. Extra columns are not read;
an empty table gives an empty result. A conversation that is rendered has to fit in one row; others need not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def rolled(conversations: DataFrame) -> DataFrame:
    """conv_id, role, text, pos (from 1), a and b (the hash of the prefix that ends here), is_last."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = conversations.select("conv_id", "turn", "role", "text").withColumns({"pos": F.row_number().over(order), "is_last": F.lead(F.lit(1)).over(order).isNull()})
    said = [F.col("pos"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    return placed.select("conv_id", "turn", "role", "text", "pos", "is_last", *[F.bit_xor(F.xxhash64(F.lit(seed), *said)).over(upto).alias(name) for name, seed in (("a", 17), ("b", 3_141_592_653))])


def render(turns: Column) -> Column:
    one = lambda t: F.concat(F.lit(START), F.coalesce(t.role, F.lit("")), F.lit("\n"), F.coalesce(t.text, F.lit("")), F.lit(END + "\n"))
    return F.concat_ws("", F.transform(turns, one))


def maximal(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies (conversations equal to it), chat. Decisions are made on hashes; only survivors' texts are gathered."""
    turns = rolled(conversations)
    ends = turns.where("is_last").groupBy("a", "b", "pos").agg(F.min(F.struct(F.col("conv_id").isNull().alias("nameless"), "conv_id")).alias("one"), F.count("*").alias("n_copies"))
    # What longer conversations pass through: every prefix but the whole.
    passed = turns.where("NOT is_last").select("a", "b", "pos").distinct()
    kept = ends.join(passed, ["a", "b", "pos"], "left_anti").select(F.col("one.conv_id").alias("kept_id"), F.col("pos").cast("long").alias("n_turns"), "n_copies")
    said = turns.join(kept, F.col("conv_id").eqNullSafe(F.col("kept_id")))
    whole = said.groupBy("conv_id", "n_turns", "n_copies").agg(F.array_sort(F.collect_list(F.struct("pos", "role", "text"))).alias("turns"))
    return whole.select("conv_id", "n_turns", "n_copies", render(F.col("turns")).alias("chat"))


#: The same by comparing whole renderings, for DuckDB.
SQL = """
WITH t AS (SELECT conv_id, list({'k': turn IS NOT NULL, 'turn': turn, 'role': role, 'text': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns FROM conversations GROUP BY conv_id),
u AS (SELECT conv_id, len(turns) AS n, list_transform(turns, lambda x: {'role': x.role, 'text': x.text}) AS said, turns FROM t),
passed AS (SELECT DISTINCT said[1:k] AS said FROM (SELECT said, unnest(range(1, n)) AS k FROM u)),
kept AS (SELECT said, min(conv_id) AS conv_id, min(n) AS n_turns, count(*) AS n_copies FROM u GROUP BY said)
SELECT conv_id, n_turns, n_copies, list_aggregate(list_transform(said, lambda x: '<|im_start|>' || coalesce(x.role, '') || chr(10) || coalesce(x.text, '') || '<|im_end|>' || chr(10)), 'string_agg', '') AS chat
FROM kept WHERE NOT EXISTS (SELECT 1 FROM passed WHERE passed.said = kept.said)
"""
