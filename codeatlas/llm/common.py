"""What the corpus operators share: scratch tables, words, hashes."""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..scratch import folder as scratch_dir
from ..scratch import at_exit, remove, save

__all__ = ["ASCII_SPACE", "LOWER_AZ", "WordHasher", "at_exit", "mix", "partitions", "remove", "save", "scratch_dir", "shingle_hashes", "small_batches", "words_of"]

#: Fixed value: ASCII white space, which alone separates words.
ASCII_SPACE = "\\x20\\x09-\\x0D"
LOWER_AZ = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def small_batches(spark: SparkSession, rows: int, size: str = "16m"):
    """Arrow batches of at most `rows` rows and about `size` for what is run inside: bounds the workers' and the JVM's buffers where rows are long."""
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {key: spark.conf.get(key) for key in limits}
    for key, value in limits.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def words_of(text: Column) -> Column:
    """Array of the words `[^\\x20\\x09-\\x0D]+`; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{ASCII_SPACE}]+"), lambda w: w != "")


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser over unsigned 64-bit integers (two rounds of multiply and shift)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class WordHasher:
    """64-bit hashes of words (bytes). Holds at most `most` words, then starts afresh."""

    def __init__(self, most: int = 150_000):
        self.most, self.known = most, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        known = self.known
        if len(known) > self.most:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingle_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` word hashes; shorter texts give their whole sequence as one."""
    if not len(h):
        return h
    k = min(size, len(h))
    out = np.full(len(h) - k + 1, np.uint64(0x9E3779B97F4A7C15 + k), np.uint64)
    for i in range(k):
        out = mix(out + h[i : len(h) - k + 1 + i])
    return out
