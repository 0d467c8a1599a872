"""A persisted index for phrase search: a row for each occurrence of a term, sorted by term and key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from .. import scratch
from ..functions import scalars

#: A term that many rows hold is spread over as many files and tasks as its rows need.
ORDER = ["term", "key"]


def occurrences(df: DataFrame, key: str, columns: Sequence[str], *carried: str) -> DataFrame:
    """term, key, part (which column), pos: every token of every column. No shuffle is needed to make them."""
    words = [F.filter(F.split(scalars.normal_text(F.col(c)), " "), lambda w: w != "") for c in columns]
    parts = df.select(F.col(key).alias("key"), *carried, F.posexplode(F.array(*words)).alias("part", "words"))
    return parts.select("key", *carried, "part", F.posexplode("words").alias("pos", "term"))


def lengths(df: DataFrame, key: str, columns: Sequence[str], *carried: str) -> DataFrame:
    """key, len: the tokens of all columns; a row without any counts, too."""
    return df.select(F.col(key).alias("key"), *carried, sum((scalars.token_count(F.col(c)) for c in columns), F.lit(0).cast("long")).alias("len"))


def write(df: DataFrame, path: str, rows: int = 0) -> None:
    """By ranges of (term, key): a query reads its terms' row groups only. rows: how many there are, if known, for as many partitions as these need."""
    scratch.by_range(df, rows, ORDER).write.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str, key_type: str) -> DataFrame:
    return spark.read.schema(f"key {key_type}, part int, pos int, term string").parquet(path)


def phrase_counts(found: DataFrame, terms: list[str]) -> DataFrame:
    """key, tf: how often the terms stand in a row within one column. Each occurrence votes for the places where the phrase would begin."""
    places = F.array(*[F.when(F.col("term") == t, F.col("pos") - k) for k, t in enumerate(terms)])
    votes = found.where(F.col("term").isin(*sorted(set(terms)))).select("key", "part", F.explode(F.filter(places, lambda p: p.isNotNull())).alias("begin"))
    hits = votes if len(terms) == 1 else votes.groupBy("key", "part", "begin").count().where(F.col("count") == len(terms))
    return hits.groupBy("key").agg(F.count("*").alias("tf"))


def search(found: DataFrame, lens: DataFrame, query: str, limit: int, n: int | None = None, total: int | None = None, where: Column | None = None) -> DataFrame:
    """key, score of the best `limit` keys by BM25, the same as `search.search_phrase`; n, total: rows and tokens of all, counted here if not given."""
    terms = scalars.tokens(query)
    empty = lens.limit(0).select("key", F.lit(0.0).alias("score"))
    if not terms:
        return empty
    if n is None or total is None:
        n, total = lens.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
    hits = phrase_counts(found, terms)
    met = hits.count()
    if not met:
        return empty
    kept = hits if where is None else hits.where(where)
    idf = F.greatest(F.log((F.lit(float(n - met)) + 0.5) / (met + 0.5)), F.lit(K.LEAST_IDF))
    score = idf * F.col("tf") * (K.K1 + 1) / (F.col("tf") + K.K1 * (1 - K.B + K.B * F.col("len") / (total / n)))
    return kept.join(lens, "key").select("key", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "key").limit(limit)
