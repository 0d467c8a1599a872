"""Embeddings learnt from the corpus itself: words that stand among the same words get near vectors.

Words (letters or digits, split where camel case does) are known by their bucket, so that the vocabulary has a bound. Tasks
count which buckets stand within a window of each other; their positive mutual information, with smoothed marginals, is a
sparse symmetric matrix of at most `BUCKETS` rows, whatever the corpus. Randomised subspace iteration finds its leading
directions: each Spark pass multiplies the stored matrix with a block of columns, QR on the driver makes it orthonormal, and a
Rayleigh-Ritz step ends it. Block and result are `BUCKETS` x (`DIMS` + `EXTRA`) numbers at most: that is what is broadcast and
what comes back.

A text's vector is the sum of its words' unit vectors, frequent words weighing less, brought to length 1. A word that the corpus
of the fit didn't hold (or held alone) has a fixed random direction of its bucket, so that equal words still meet. A text without
a word, or null, has none. Texts may be of any length; all rows count, copies too.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch

BUCKETS, DIMS, WINDOW = 16384, 384, 4
#: Columns beyond DIMS that a block has, passes over the matrix, and the exponent of smoothed marginals.
EXTRA, PASSES, SMOOTH = 32, 4, 0.75
#: A word of this share of all words weighs half as much as a rare one.
HALF = 1e-3
#: Whole texts that a task holds at once while contexts are counted.
TEXTS_AT_ONCE = 256
#: Words whose pairs are counted at once, entries multiplied at once, and rows of a batch that is sent.
WORDS_AT_ONCE, ENTRIES_AT_ONCE, ROWS_AT_ONCE = 1 << 19, 4096, 512


def buckets(text: Column, n: int = BUCKETS) -> Column:
    """Buckets of a text's words in their order; null for null."""
    split = F.regexp_replace(F.regexp_replace(text, r"([\p{Ll}\p{N}])(\p{Lu})", "$1 $2"), r"(\p{Lu})(\p{Lu}\p{Ll})", "$1 $2")
    words = F.regexp_extract_all(F.lower(split), F.lit(r"[\p{L}\p{M}]+|\p{N}+"), F.lit(0))
    return F.transform(words, lambda w: F.pmod(F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(n)).cast("int"))


def context_counts(texts: DataFrame, column: str, window: int = WINDOW) -> DataFrame:
    """a <= b, n: how often two buckets stand d words apart, summed over d up to `window` with weight window + 1 - d."""
    schema = pa.schema([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])
    bits = window.bit_length()

    def run(batches):
        for batch in batches:
            held = batch.column(0)
            words = held.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            text = np.repeat(np.arange(len(held)), held.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            for start in range(0, len(words), WORDS_AT_ONCE):
                keys = []
                for d in range(1, window + 1):
                    here = np.arange(start, max(start, min(start + WORDS_AT_ONCE, len(words) - d)))
                    here = here[text[here] == text[here + d]]
                    x, y = words[here], words[here + d]
                    # The weight stands in the lowest bits, so that sorting needs no order of its own.
                    keys.append((np.minimum(x, y) << 31 | np.maximum(x, y)) << bits | window + 1 - d)
                keys = np.sort(np.concatenate(keys))
                pairs = keys >> bits
                first = np.flatnonzero(np.diff(pairs, prepend=-1))
                pairs, n = pairs[first], np.add.reduceat(keys & (1 << bits) - 1, first) if len(first) else first
                yield pa.RecordBatch.from_arrays([pa.array((pairs >> 31).astype(np.int32)), pa.array((pairs & 0x7FFFFFFF).astype(np.int32)), pa.array(n.astype(np.int64))], schema=schema)

    counted = texts.where(F.col(column).isNotNull()).select(column).mapInArrow(run, "a int, b int, n long")
    return counted.groupBy("a", "b").agg(F.sum("n").alias("n"))


def both_ways(counts: DataFrame) -> DataFrame:
    """The symmetric matrix of `context_counts`."""
    return counts.selectExpr("inline(if(a = b, array(struct(a, b, 2 * n AS n)), array(struct(a, b, n), struct(b AS a, a AS b, n))))")


def marginals(counts: DataFrame) -> DataFrame:
    """bucket, n (its weight in all pairs), contexts (how many buckets it meets)."""
    return both_ways(counts).groupBy(F.col("a").alias("bucket")).agg(F.sum("n").alias("n"), F.count("*").alias("contexts"))


@dataclass
class Model:
    """Sorted buckets with their shares of all words and unit vectors."""

    buckets: np.ndarray
    shares: np.ndarray
    vectors: np.ndarray
    dims: int = DIMS
    values: np.ndarray | None = None
    strange: dict[int, np.ndarray] = field(default_factory=dict)

    def vector(self, words) -> np.ndarray | None:
        """A text's vector from its buckets."""
        if words is None or not len(words):
            return None
        found, times = np.unique(np.asarray(words, np.int64), return_counts=True)
        at = np.searchsorted(self.buckets, found)
        known = at < len(self.buckets)
        known[known] = self.buckets[at[known]] == found[known]
        out = (times[known] * HALF / (HALF + self.shares[at[known]])) @ self.vectors[at[known]].astype(np.float64)
        for b, n in zip(found[~known].tolist(), times[~known]):
            out = out + n * self._direction(b)
        size = np.linalg.norm(out)
        return (out / size).astype(np.float32) if size > 1e-9 else None

    def _direction(self, bucket: int) -> np.ndarray:
        if bucket not in self.strange:
            x = np.random.default_rng(bucket).standard_normal(self.dims)
            self.strange[bucket] = x / np.linalg.norm(x)
        return self.strange[bucket]

    def table(self, spark: SparkSession) -> DataFrame:
        """bucket, share, vector: at most a row for each bucket."""
        rows = pa.FixedSizeListArray.from_arrays(pa.array(self.vectors.astype(np.float32).ravel()), self.dims).cast(pa.list_(pa.float32()))
        return spark.createDataFrame(pa.table({"bucket": pa.array(self.buckets.astype(np.int32)), "share": pa.array(self.shares), "vector": rows}))


def read(table: DataFrame, dims: int = DIMS) -> Model:
    """The model of `Model.table`, or of some of its rows."""
    rows = table.select("bucket", "share", "vector").orderBy("bucket").toArrow()
    vectors = rows["vector"].combine_chunks().flatten().to_numpy().reshape(-1, dims)
    return Model(rows["bucket"].to_numpy().astype(np.int64), rows["share"].to_numpy(), vectors, dims)


def fit(texts: DataFrame, column: str, dims: int = DIMS, window: int = WINDOW, passes: int = PASSES) -> Model:
    """Learn from texts given as `buckets`. Of few distinct buckets (at most dims + EXTRA) the directions are exact."""
    spark = texts.sparkSession
    at = scratch.folder(spark)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, str(TEXTS_AT_ONCE))
    try:
        counts = scratch.save(context_counts(texts, column, window), f"{at}-counts")
    finally:
        spark.conf.set(size, before)
    sums = marginals(counts).select("bucket", "n").orderBy("bucket").toArrow()
    names, n = sums["bucket"].to_numpy().astype(np.int64), sums["n"].to_numpy().astype(np.float64)
    if not len(names):
        scratch.remove(spark, f"{at}-counts")
        return Model(names, n, np.zeros((0, dims), np.float32), dims)
    smooth = n**SMOOTH
    logs = spark.createDataFrame(pd.DataFrame({"bucket": names.astype(np.int32), "log_share": np.log(smooth / smooth.sum())}))
    of = lambda c: F.broadcast(logs.select(F.col("bucket").alias(c), F.col("log_share").alias(f"log_{c}")))
    mutual = F.log(F.col("n") / F.lit(float(n.sum()))) - F.col("log_a") - F.col("log_b")
    matrix = both_ways(counts).join(of("a"), "a").join(of("b"), "b").select("a", "b", mutual.cast("float").alias("w")).where("w > 0")
    matrix = scratch.save(matrix.repartitionByRange("a").sortWithinPartitions("a", "b"), f"{at}-matrix")
    values, vectors = leading(matrix, names, dims, passes)
    scratch.remove(spark, f"{at}-counts", f"{at}-matrix")
    vectors = vectors * np.sqrt(np.abs(values))
    size = np.linalg.norm(vectors, axis=1)
    held = size > 1e-9 * max(size.max(), 1e-300)  # a bucket that meets others no more often than chance has no direction
    full = np.zeros((int(held.sum()), dims), np.float32)
    full[:, : vectors.shape[1]] = vectors[held] / size[held, None]
    return Model(names[held], (n / n.sum())[held], full, dims, values)


def leading(matrix: DataFrame, names: np.ndarray, k: int, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of the largest size, and their vectors as columns, of a symmetric matrix (a, b, w) over the buckets `names`."""
    size = len(names)
    width = min(size, k + EXTRA)
    if width == size:
        q = np.eye(size)
        image = product(matrix, names, q)
    else:
        q = np.linalg.qr(np.random.default_rng(7).standard_normal((size, width)))[0]
        for _ in range(passes - 1):
            q = np.linalg.qr(product(matrix, names, q))[0]
        image = product(matrix, names, q)
    h = q.T @ image
    values, y = np.linalg.eigh((h + h.T) / 2)
    best = np.argsort(-np.abs(values), kind="stable")[:k]
    return values[best], q @ y[:, best]


def product(matrix: DataFrame, names: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The matrix times q: each task multiplies the entries it reads, in single precision, and sends a row of the result for each row it met."""
    held = matrix.sparkSession.sparkContext.broadcast((names, q.astype(np.float32)))
    schema = pa.schema([("i", pa.int32()), ("v", pa.binary())])

    def run(batches):
        names, q = held.value
        total, met = None, None
        for batch in batches:
            row, col = (np.searchsorted(names, batch.column(c).to_numpy()) for c in (0, 1))
            w = batch.column(2).to_numpy().astype(np.float32)
            if total is None:
                total, met = np.zeros(q.shape), np.zeros(len(names), bool)
            met[row] = True
            for s in range(0, len(w), ENTRIES_AT_ONCE):
                r, c = row[s : s + ENTRIES_AT_ONCE], col[s : s + ENTRIES_AT_ONCE]
                first = np.flatnonzero(np.diff(r, prepend=-1)).tolist()
                for x, y in zip(first, [*first[1:], len(r)]):
                    total[r[x]] += w[s + x : s + y] @ q[c[x:y]]
        rows = np.flatnonzero(met) if met is not None else []
        for s in range(0, len(rows), ROWS_AT_ONCE):
            some = rows[s : s + ROWS_AT_ONCE]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([total[i].tobytes() for i in some], pa.binary())], schema=schema)

    out = np.zeros(q.shape)
    sent = matrix.select("a", "b", "w").mapInArrow(run, "i int, v binary").toArrow()
    for i, v in zip(sent["i"].to_pylist(), sent["v"]):
        out[i] += np.frombuffer(v.as_buffer(), np.float64)
    held.destroy()  # its copies on disk, too
    return out


def embedded(df: DataFrame, words: Column, model: Model, name: str = "embedding") -> DataFrame:
    """df with the vector of each text, given as its buckets."""
    held = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<float>")
    def run(batch: pd.Series) -> pd.Series:
        return pd.Series([held.value.vector(b) for b in batch], dtype=object)

    return df.withColumn(name, run(words))


def ask(spark: SparkSession, text: str, model: DataFrame) -> list[float] | None:
    """A query's vector; only its words' rows of the model's table are read."""
    words = spark.range(1).select(buckets(F.lit(text)).alias("w")).first()["w"]
    vector = read(model.where(F.col("bucket").isin(sorted(set(words))))).vector(words) if words else None
    return None if vector is None else vector.tolist()
