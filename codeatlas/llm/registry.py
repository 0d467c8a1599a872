"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, hard_negatives, html_mincut, language_id, license_scan, ngram_join, quality_rules, secret_scan, soft_mixing, token_blocks, warc, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(table(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.maximal(table(spark, sf_dir, "conversations"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


#: Shares of tokens by domain: what is neither low nor toxic makes up nearly all.
TARGETS = {"good": 0.97, "low": 0.01, "toxic": 0.02}
ANCHOR = "good"


def op5_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    classifier = soft_mixing.learn(docs, soft_mixing.domain_table(table(spark, sf_dir, "labels")))
    if classifier is None:  # no labels: rates of 1, and no memberships
        words = F.size(soft_mixing.words_of(F.col("text"))).cast("long")
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), words.alias("tokens"), *[F.lit(None).cast("double").alias(f"p_{d}") for d in TARGETS], F.lit(1.0).alias("rate"), F.lit(1).alias("copies"))
    rated = soft_mixing.rates(docs, classifier, TARGETS, ANCHOR)
    of = {d: F.col("p")[i] for i, d in enumerate(classifier.domains)}
    return rated.select("doc_id", "tokens", *[of.get(d, F.lit(0.0)).alias(f"p_{d}") for d in TARGETS], "rate", "copies")


def op6_html_mincut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_mincut.extract(table(spark, sf_dir, "pages"))


def op7_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_blocks.encode(table(spark, sf_dir, "documents"), tokenizer_path())


def document_path() -> Column:
    """`documents` has no paths: source and language stand for directories."""
    return F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"), document_path())


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    forest = secret_scan.fit(secret_scan.labelled_findings(spark))
    return secret_scan.scan(table(spark, sf_dir, "documents"), document_path(), forest)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), noisy, F.col("vec_id") % 50 == 0)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": chat_format.SQL, "op11_hard_negatives": hard_negatives.SQL, "op12_warc": warc.SQL}
