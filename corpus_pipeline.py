"""From raw documents to token shards, in stages that each work on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeatlas.llm import decontaminate, ngram_join, quality_rules, registry, soft_mixing, token_blocks
from codeatlas.scratch import folder as scratch_dir
from codeatlas.scratch import remove, save


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: rejected documents go."""
    return quality_rules.keep(docs, quality_rules.fit(docs, registry.table(spark, sf_dir, "labels")))


def free_name(docs: DataFrame) -> str:
    """A column name that docs don't have."""
    taken, name = {c.lower() for c in docs.columns}, "row"
    while name in taken:
        name += "_"
    return name


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1, at five words and a similarity of 0.8: of each group of linked rows the one with the smallest doc_id stays, rows without doc_id last. A row is known by doc_id and text: of repeated ones one stays."""
    key, row = F.xxhash64("doc_id", "text"), free_name(docs)
    rows = docs.select(key.alias("row"), "doc_id").distinct()
    groups = ngram_join.link(docs.select(key.alias("doc_id"), "text"), size=5, num=4, den=5).select(F.col("doc_id").alias("row"), "component_id").distinct()
    first = rows.join(groups, "row").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row")).alias("first"))
    keyed = docs.select(*docs.columns, key.alias(row))
    return keyed.join(first.select(F.col("first.row").alias(row)), row, "left_semi").dropDuplicates([row]).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that hold a benchmark item go, known by their text, so those without doc_id go, too."""
    key, row = F.xxhash64("text"), free_name(docs)
    found = decontaminate.leaks(docs.select(key.alias("doc_id"), "text"), registry.table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(row)).distinct()
    return docs.select(*docs.columns, key.alias(row)).join(found, row, "left_anti").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: each document is taken as often as its rate says. Targets of unwanted domains are ceilings: stage 1 has removed most of the low one."""
    classifier = soft_mixing.learn(docs, soft_mixing.domain_table(registry.table(spark, sf_dir, "labels")))
    return docs if classifier is None else soft_mixing.mix(docs, soft_mixing.rates(docs, classifier, registry.TARGETS, registry.ANCHOR, only_lower=True))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: token shards, read back."""
    return token_blocks.encode(docs, registry.tokenizer_path())


STAGES = [("quality_rules", quality), ("ngram_join", near_copies), ("decontamination", decontamination), ("mixing", mixing), ("token_blocks", tokens)]

#: The stages learn models and write files: SQL can't express them, tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = registry.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        at = f"{scratch_dir(spark)}-{name}"
        docs = save(stage(spark, docs, sf_dir), at)
        if before:
            remove(spark, before)
        before = at
    return docs
