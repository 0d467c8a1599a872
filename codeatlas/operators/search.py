"""Phrase search by BM25, snippets, nearest vectors, and reciprocal rank fusion."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import patterns, scalars


def phrase_counts(df: DataFrame, columns: Sequence[str], terms: Sequence[str]) -> DataFrame:
    """df with _met (whether a column holds the terms as a phrase), _tf (how often, over all columns) and _len (tokens of all columns). Only texts that hold every term are split."""
    phrase = " ".join(terms)
    normal = df.withColumns({f"_n{k}": F.when(_holds(c, terms), scalars.normal_text(F.col(c))).otherwise("") for k, c in enumerate(columns)})
    each = [F.col(f"_n{k}") for k in range(len(columns))]
    # The lookahead counts overlapping repeats.
    tf = sum((F.regexp_count(n, F.lit(f" (?={phrase} )")) for n in each), F.lit(0))
    size = sum((scalars.token_count(F.col(c)) for c in columns), F.lit(0).cast("long"))
    met = reduce(or_, (n.contains(f" {phrase} ") for n in each))
    return normal.select(*df.columns, met.alias("_met"), tf.alias("_tf"), size.alias("_len"))


def _holds(column: str, terms: Sequence[str]) -> Column:
    return reduce(and_, (scalars.folded(F.col(column)).contains(t) for t in sorted(set(terms))))


def search_phrase(df: DataFrame, columns: Sequence[str], query: str, key: str, limit: int = 20, where: Column | None = None) -> DataFrame:
    """The best `limit` rows by BM25, with `score` (rounded to 6 places, higher is better); ties by key. `where` filters hits, not the statistics.

    One scan for the statistics and one for the hits.
    """
    terms = scalars.tokens(query)
    nothing = df.limit(0).withColumn("score", F.lit(0.0))
    if not terms:
        return nothing
    n, total, found = phrase_counts(df, columns, terms).agg(F.count("*"), F.sum("_len"), F.count_if("_met")).first()
    if not found:
        return nothing
    idf = F.greatest(F.log((F.lit(float(n - found)) + 0.5) / (found + 0.5)), F.lit(K.LEAST_IDF))
    score = idf * F.col("_tf") * (K.K1 + 1) / (F.col("_tf") + K.K1 * (1 - K.B + K.B * F.col("_len") / (total / n)))
    some = df.where(reduce(or_, (_holds(c, terms) for c in columns)))
    some = some if where is None else some.where(where)
    scored = phrase_counts(some, columns, terms).withColumn("score", F.when(F.col("_tf") > 0, F.round(score, 6))).drop("_met", "_tf", "_len")
    # Rows without the phrase go last and then out: a filter before the limit would be pushed down and split each text twice.
    return scored.orderBy(F.desc_nulls_last("score"), key).limit(limit).where(F.col("score").isNotNull())


def snippet(text: Column, query: str, width: int = 40) -> Column:
    """About `width` tokens around the first hit, which stands in >>> <<<; ... where the text is cut. Without a hit, the first tokens."""
    words = scalars.tokens(query)
    token, gap = r"[\p{L}\p{N}]+", r"[^\p{L}\p{N}]+"
    before = (width - len(words)) // 2
    after = width - len(words) - before
    pattern = rf"(?is)(?:^|[^\p{{L}}\p{{N}}])((?:{token}{gap}){{0,{before}}})({gap.join(words)})((?:{gap}{token}){{0,{after}}})(?:$|[^\p{{L}}\p{{N}}])"
    get = lambda k: F.regexp_extract(text, pattern, k)
    start, end = text.startswith(F.concat(get(1), get(2))), text.endswith(F.concat(get(2), get(3)))
    hit = F.concat(F.when(start, "").otherwise("..."), get(1), F.lit(">>>"), get(2), F.lit("<<<"), get(3), F.when(end, "").otherwise("..."))
    first = F.regexp_extract(text, rf"(?s)^(?:{gap})?(?:{token}(?:{gap})?){{0,{width}}}", 0)
    return F.when(get(2) != "", hit).otherwise(first)


def search_text(files: DataFrame, query: str, glob: str | None = None, limit: int = 20) -> DataFrame:
    """path, snippet, score over (path, content)."""
    where = F.col("path").rlike(patterns.glob_regex(glob)) if glob else None
    top = search_phrase(files.select("path", "content"), ["path", "content"], query, "path", K.clamp(1, limit, K.MAX_HITS), where)
    return top.select("path", snippet(F.col("content"), query).alias("snippet"), "score")


def distance(vector: Column, query: Sequence[float]) -> Column:
    terms = F.zip_with(vector, F.array(*[F.lit(float(x)) for x in query]), lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))
    return F.sqrt(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x))


def nearest(vectors: DataFrame, query: Sequence[float], key: str, vector: str, limit: int = 20) -> DataFrame:
    """Rows with the least Euclidean distance (rounded to 6 places), ties by key."""
    return vectors.withColumn("distance", F.round(distance(F.col(vector), query), 6)).orderBy("distance", key).limit(limit)


def fuse(arms: Sequence[DataFrame], key: str, limit: int, kind: str | None = None) -> DataFrame:
    """Reciprocal rank fusion of ranked arms (key, kind, pos from 0). The kind filter stands after fusion, so fewer than `limit` rows may come."""
    both = arms[0].withColumn("arm", F.lit(0))
    for k, arm in enumerate(arms[1:], 1):
        both = both.unionByName(arm.withColumn("arm", F.lit(k)))
    # Duplicates of a key in an arm add up. The row's data are the first arm's last, else the next arm's first.
    fused = both.groupBy(key).agg(
        F.sum(1.0 / (K.RRF_K + F.col("pos"))).alias("raw"), F.min(F.struct("arm", "pos")).alias("first"),
        F.coalesce(F.max_by("kind", F.when(F.col("arm") == 0, F.col("pos"))), F.min_by("kind", F.struct("arm", "pos"))).alias("kind"),
    )
    kept = fused.where(F.col("kind") == kind) if kind else fused
    return kept.orderBy(F.desc("raw"), "first", key).limit(limit).select(key, "kind", F.round("raw", 4).alias("score"))


def ranked(top: DataFrame, *order) -> DataFrame:
    """0-based positions of the rows of a top-k; the window's single partition holds these few rows."""
    return top.withColumn("pos", F.row_number().over(Window.orderBy(*order)) - 1)
