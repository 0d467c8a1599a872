"""Exact nearest neighbours that read few clusters.

Vectors are kept by their nearest centre, with their distance to it. By the triangle inequality no vector of a cluster is
nearer to a query than the query's distance to the centre less the cluster's radius. The clusters of the least such bound
that hold enough rows are read first; their last hit's distance says which others can still hold a nearer one, and only
those are read. Centres are fitted on a bounded sample; they change what is read, never what is found.

Many queries meet parts of clusters in blocks: matrix products, with room for their rounding, say which pairs can count, and
only the distances of these are summed entry by entry.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch
from . import blocks, search

#: Distances are rounded to 6 places, so that ties within that are possible.
SLACK = 2e-6
#: Queries and rows of one matrix product, and pairs held before the best of them are picked.
QUERIES_AT_ONCE, ROWS_AT_ONCE, MOST_HELD = 256, 4096, 1 << 20


def centres(vectors: DataFrame, column: str, most: int = 32, sample: int = 2000, rounds: int = 8) -> list[list[float]]:
    """At most `most` centres, fitted on the `sample` vectors of the lowest hash; of vectors of several lengths, those of the most frequent one."""
    whole = vectors.where(F.col(column).isNotNull()).select(F.col(column).alias("v"))
    rows = blocks.sample(whole, F.xxhash64("v"), sample, whole.count())["v"].to_pylist()
    sizes = [len(v) for v in rows]
    if not sizes:
        return []
    size = max(sorted(set(sizes)), key=sizes.count)
    x = np.unique(np.array([v for v in rows if len(v) == size], float), axis=0)
    x = x[np.isfinite(x).all(axis=1)]
    if not len(x):
        return []
    out = x[np.linspace(0, len(x) - 1, min(most, max(1, len(x) // 8))).astype(int)]
    for _ in range(rounds):
        near = ((x[:, None] - out[None]) ** 2).sum(axis=2).argmin(axis=1)
        out = np.array([x[near == k].mean(axis=0) for k in np.unique(near)])
    return out.tolist()


def assigned(vectors: DataFrame, column: str, held: Sequence[Sequence[float]]) -> DataFrame:
    """vectors with cluster and away (distance to its centre). What has no place among the centres (null, not finite, another length) is in cluster -1, which every search reads."""
    c = np.array(held, float)

    @F.pandas_udf("cluster int, away double")
    def place(batch: pd.Series) -> pd.DataFrame:
        cluster, away = np.full(len(batch), -1, np.int32), np.zeros(len(batch))
        fits = [k for k, v in enumerate(batch) if v is not None and len(c) and len(v) == c.shape[1] and np.isfinite(np.asarray(v, float)).all()]
        if fits:
            d = np.sqrt(((np.array([batch.iloc[k] for k in fits], float)[:, None] - c[None]) ** 2).sum(axis=2))
            cluster[fits] = d.argmin(axis=1)
            away[fits] = d.min(axis=1)
        return pd.DataFrame({"cluster": cluster, "away": away})

    return vectors.withColumn("_p", place(column)).select(*vectors.columns, "_p.cluster", "_p.away")


def directory(placed: DataFrame) -> dict[int, tuple[float, int]]:
    """Radius and rows of each cluster; two narrow columns are read."""
    return {r["cluster"]: (r["radius"], r["n"]) for r in placed.groupBy("cluster").agg(F.max("away").alias("radius"), F.count("*").alias("n")).collect()}


def bounds(held: Sequence[Sequence[float]], known: dict[int, tuple[float, int]], queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Clusters, and for each query the least distance that each of them can hold."""
    c, names = np.array(held, float), np.array(sorted(known), np.int64)
    radius = np.array([known[k][0] for k in names.tolist()])
    out = np.zeros((len(queries), len(names)))
    real = names >= 0
    if real.any():
        out[:, real] = np.maximum(0, np.sqrt(((queries[:, None] - c[names[real]][None]) ** 2).sum(axis=2)) - radius[real] - 1e-9)
    return names, out


def first_wave(names: np.ndarray, bound: np.ndarray, known: dict[int, tuple[float, int]], limit: int) -> list[int]:
    """The clusters of the least bounds that hold `limit` rows together; cluster -1 in any case."""
    out, n = [-1] if -1 in known else [], 0
    for k in np.argsort(bound, kind="stable").tolist():
        if names[k] >= 0 and n < limit:
            out.append(int(names[k]))
            n += known[int(names[k])][1]
    return out


def nearest(placed: DataFrame, held: Sequence[Sequence[float]], query: Sequence[float], key: str, column: str, limit: int = 20) -> tuple[DataFrame, list[int]]:
    """What `search.nearest` finds among the rows of `assigned`, and the clusters that are read for it."""
    known = directory(placed)
    if not known or not held or len(query) != len(held[0]):
        return search.nearest(placed, query, key, column, limit).drop("cluster", "away"), sorted(known)
    names, bound = bounds(held, known, np.array([query], float))
    wave = first_wave(names, bound[0], known, limit)
    top = search.nearest(placed.where(F.col("cluster").isin(wave)), query, key, column, limit).select("distance").collect()
    last = top[-1]["distance"] if len(top) == limit and top[-1]["distance"] is not None else math.inf
    more = [int(k) for k, b in zip(names, bound[0]) if b <= last + SLACK and int(k) not in wave]
    return search.nearest(placed.where(F.col("cluster").isin(wave + more)), query, key, column, limit).drop("cluster", "away"), sorted(wave + more)


def _nearest_of_part(limit: int, width: int):
    """For `blocks.meet`: query_id, key, distance (not rounded) of the rows of a part that can be among the first `limit` of a query."""

    def run(asked: pa.Table, stored: pa.Table) -> pa.Table:
        matrix = lambda c: c.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
        q, x, cluster = matrix(asked["vector"]), matrix(stored["stored"]), stored["cluster"].to_numpy()
        last = asked["last"].fill_null(math.inf).to_numpy() + SLACK
        place = np.empty(len(x), np.int64)
        place[pc.sort_indices(stored["key"].combine_chunks(), null_placement="at_start").to_numpy()] = np.arange(len(x))
        squares, own = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", q, q)
        wanted = [set(c) for c in asked["clusters"].to_pylist()]
        held, n = [], 0

        def pick(every):
            """The first `limit` pairs of each query by distance and key, and those that rounding may bring among them."""
            i, j, d = (np.concatenate(c) for c in zip(*every))
            order = np.lexsort((place[j], d, i))
            i, j, d = i[order], j[order], d[order]
            nth = lambda new: np.arange(len(i)) - np.repeat(np.flatnonzero(new), np.diff(np.r_[np.flatnonzero(new), len(i)]))
            of_query = np.r_[True, i[1:] != i[:-1]]
            full = nth(of_query) == limit - 1
            last[i[full]] = np.minimum(last[i[full]], d[full] + SLACK)
            kept = (d <= last[i]) & (nth(of_query | np.r_[True, d[1:] != d[:-1]]) < limit)
            return i[kept], j[kept], d[kept]

        for c in np.unique(cluster).tolist():
            rows, who = np.flatnonzero(cluster == c), np.array([k for k, w in enumerate(wanted) if c in w], np.int64)
            for a in range(0, len(who), QUERIES_AT_ONCE):
                ask = who[a : a + QUERIES_AT_ONCE]
                for b in range(0, len(rows), ROWS_AT_ONCE):
                    some = rows[b : b + ROWS_AT_ONCE]
                    near = own[ask][:, None] + squares[some][None] - 2 * (q[ask] @ x[some].T)
                    room = 1e-12 * (own[ask] + squares[some].max())
                    if len(some) >= limit and np.isinf(last[ask]).any():
                        kth = np.partition(near, limit - 1, axis=1)[:, limit - 1]
                        last[ask] = np.minimum(last[ask], np.sqrt(np.maximum(kth + room, 0)) + SLACK)
                    i, j = np.nonzero(near <= (last[ask] ** 2 + room)[:, None])
                    i, j = ask[i], some[j]
                    total = np.zeros(len(i))
                    for t in range(x.shape[1]):  # in the order of `search.distance`, so that sums are the same to the last bit
                        total += np.square(x[j, t] - q[i, t])
                    held.append((i, j, np.sqrt(total)))
                    n += len(i)
                    if n >= MOST_HELD:
                        held = [pick(held)]
                        n = 0
        i, j, d = pick(held) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query_id": asked["query_id"].take(i), "key": stored["key"].take(j), "distance": d})

    return run


def nearest_all(placed: DataFrame, held: Sequence[Sequence[float]], queries: DataFrame, key: str, column: str, limit: int = 20) -> DataFrame:
    """query_id, key, distance, rank of the nearest rows of each query (query_id, vector), and read, how many clusters its search read."""
    spark = placed.sparkSession
    at, known = scratch.folder(spark), directory(placed)
    width = len(held[0]) if held else 0
    counts = [known[c][1] if c in known else 0 for c in range(len(held))]
    first_part, splits = blocks.parts(counts, blocks.rows_of_part(sum(counts), width, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def clusters_of(last: Column | None):
        begin = last is None

        @F.pandas_udf("array<int>")
        def run(batch: pd.Series, odd: pd.Series, least: pd.Series) -> pd.Series:
            fits = np.flatnonzero(~odd.to_numpy(bool)).tolist()
            out: list[list[int]] = [sorted(known) for _ in range(len(batch))]
            if fits:
                names, b = bounds(held, known, np.array([batch.iloc[k] for k in fits], float))
                for row, k in zip(b, fits):
                    wave = first_wave(names, row, known, limit)
                    out[k] = wave if begin else [int(c) for c, x in zip(names, row) if x <= (math.inf if pd.isna(least.iloc[k]) else least.iloc[k]) + SLACK and int(c) not in wave]
            return pd.Series(out)

        return run("vector", "odd", F.lit(None).cast("double") if begin else last)

    stored = placed.select("cluster", F.col(key).alias("key"), F.col(column).alias("stored"))
    types = {c: df.schema[c].dataType.simpleString() for df, c in ((stored, "key"), (queries, "query_id"))}
    order = Window.partitionBy("query_id").orderBy("distance", "key")
    of = lambda values: F.array(*[F.lit(int(v)) for v in values])
    number = (F.element_at(of(first_part), F.col("cluster") + 1) + F.pmod(F.xxhash64("key"), F.element_at(of(splits), F.col("cluster") + 1).cast("long")).cast("int")) if held else F.lit(0)
    dealt = stored.where("cluster >= 0").withColumn("part", number)

    def by_row(asked: DataFrame, rows: DataFrame) -> DataFrame:
        pairs = asked.select("query_id", "vector", F.explode("clusters").alias("cluster")).join(rows, "cluster")
        terms = F.zip_with("stored", "vector", lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))
        return pairs.select("query_id", "key", F.sqrt(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)).alias("distance"))

    def best(asked: DataFrame, before: DataFrame | None) -> DataFrame:
        plain = asked.where("NOT odd")
        visits = F.transform(F.filter("clusters", lambda c: c >= 0), lambda c: F.sequence(F.element_at(of(first_part), c + 1), F.element_at(of(first_part), c + 1) + F.element_at(of(splits), c + 1) - 1))
        found = []
        if any(counts) and regular:
            visiting = plain.select("query_id", "vector", "last", "clusters", F.explode(F.array_distinct(F.flatten(visits))).alias("part"))
            found.append(blocks.meet(visiting, dealt, "query_id", max(1, -(-regular * 8 * width // blocks.ASKED)), _nearest_of_part(limit, width), f"query_id {types['query_id']}, key {types['key']}, distance double"))
        if -1 in known and regular:  # rows without a place among the centres
            found.append(by_row(plain, stored.where("cluster = -1")))
        if strange and before is None:  # such queries read everything at once
            found.append(by_row(asked.where("odd"), stored))
        out = reduce(DataFrame.unionByName, found) if found else by_row(asked, stored).limit(0)
        out = out.withColumn("distance", F.round("distance", 6))
        out = out if before is None else out.unionByName(before.drop("rank"))
        return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)

    finite = F.forall("vector", lambda x: F.coalesce(F.abs(x) < F.lit(math.inf), F.lit(False)))
    queries = queries.select("query_id", F.transform("vector", lambda x: x.cast("double")).alias("vector"))
    queries = queries.withColumn("odd", ~F.coalesce((F.size("vector") == width) & finite, F.lit(False)) if held else F.lit(True))
    first = scratch.save(queries.withColumn("clusters", clusters_of(None)), f"{at}-wave")
    strange, asking = first.agg(F.count_if("odd"), F.count("*")).first()
    regular = asking - strange
    top = scratch.save(best(first.withColumn("last", F.lit(None).cast("double")), None), f"{at}-top")
    last = top.where(F.col("rank") == limit).select("query_id", F.col("distance").alias("last"))
    asked = first.withColumnRenamed("clusters", "wave").join(last, "query_id", "left")
    second = scratch.save(asked.withColumn("clusters", clusters_of(F.col("last"))), f"{at}-rest")
    read = second.select("query_id", F.when(F.col("odd"), F.size("wave")).otherwise(F.size("wave") + F.size("clusters")).alias("read"))
    return best(second, top).join(read, "query_id").select("query_id", F.col("key").alias(key), "distance", "rank", "read")
