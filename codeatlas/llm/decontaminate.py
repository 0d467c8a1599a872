"""Benchmark decontamination by greedy string tiling.

Tokens are lower-case runs of letters and digits, known by 64-bit hashes. A document and a benchmark item that share a run
of `min_match` tokens (a seed) are tiled: the longest match of tokens that no earlier tile has marked becomes a tile, again
and again, until no match of `min_match` tokens is left. Matches are found by Karp-Rabin hashes of `min_match` tokens, run
together along diagonals and checked token by token. A pair is reported if tiles cover `threshold` of the item's tokens;
order between tiles is free, so reordered passages count. Items shorter than `min_match` tokens are their own seed and have
to be found as a whole.

One pass over the texts keeps the documents with a seed that the benchmark may have, by a sieve of bounded size that every
task holds. Their seeds are joined with the benchmark's; pairs whose shared seeds could cover enough of the item go on to
be tiled. Neither the benchmark nor the documents pass through the driver.

Null or empty texts match nothing, on either side. Repeated documents or items each give their own rows; null ids are
carried. Extra columns are not read; empty tables give an empty result. A token repeated without end makes no more matches
than there are diagonals.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, mix, remove, save, scratch_dir

TOKEN = re.compile(r"[^\W_]+")
RESULT = "doc_id long, item_id long, item_tokens long, covered_tokens long, tiles long"


def tokens_of(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


def karp_rabin(x: np.ndarray, width: int) -> np.ndarray:
    """Rolling polynomial hash (mod 2^64) of each run of `width` token hashes; another for each width."""
    out = np.full(max(0, len(x) - width + 1), np.uint64(width), np.uint64)
    for i in range(width if len(out) else 0):
        out = out * np.uint64(0x9E3779B97F4A7C15) + x[i : len(x) - width + 1 + i]
    return mix(out)


def runs(item: np.ndarray, text: np.ndarray, width: int, most_pairs: int | None = None) -> list[tuple[int, int, int]]:
    """Maximal matches (item start, text start, length) of `width` tokens or more.

    Equal seeds are put together at once where they are few, else one place of the item after another, so that a repeated
    token takes memory for the text's places only.
    """
    mine, theirs = karp_rabin(item, width), karp_rabin(text, width)
    order = np.argsort(theirs, kind="stable")
    low, high = np.searchsorted(theirs[order], mine), np.searchsorted(theirs[order], mine, "right")
    n = high - low
    if n.sum() <= (4 * (len(item) + len(text)) if most_pairs is None else most_pairs):
        i = np.repeat(np.arange(len(mine)), n)
        j = order[np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
        by = np.lexsort((i, j - i))
        i, j = i[by], j[by]
        first = np.flatnonzero(np.r_[True, (np.diff(j - i) != 0) | (np.diff(i) != 1)]) if len(i) else i
        found = [(int(i[k]), int(j[k]), int(m) + width - 1) for k, m in zip(first, np.diff(np.r_[first, len(i)]))]
    else:
        begins, ends, none = [], [], np.zeros(0, np.int64)
        at = lambda i: order[low[i] : high[i]] if 0 <= i < len(mine) else none
        before, here = none, at(0)
        for i in range(len(mine)):
            after = at(i + 1)
            begins += [(j - i, i) for j in here[~np.isin(here - 1, before)].tolist()]
            ends += [(j - i, i) for j in here[~np.isin(here + 1, after)].tolist()]
            before, here = here, after
        found = [(i, d + i, e - i + width) for (d, i), (_, e) in zip(sorted(begins), sorted(ends))]
    return [(i, j, m) for i, j, m in found if (item[i : i + m] == text[j : j + m]).all()]


def tiles(item: np.ndarray, text: np.ndarray, min_match: int, most_pairs: int | None = None) -> list[tuple[int, int, int]]:
    """Greedy tiles (item start, text start, length)."""
    heap = [(-n, i, j) for i, j, n in runs(item, text, min_match, most_pairs)]
    heapq.heapify(heap)
    in_item, in_text, out = np.zeros(len(item), bool), np.zeros(len(text), bool), []
    while heap:
        n, a, b = heapq.heappop(heap)
        n = -n
        taken = np.flatnonzero(in_item[a : a + n] | in_text[b : b + n])
        if not len(taken):
            out.append((a, b, n))
            in_item[a : a + n] = in_text[b : b + n] = True
            continue
        edges = np.r_[-1, taken, n]
        for s, e in zip(edges[:-1] + 1, edges[1:]):
            if e - s >= min_match:
                heapq.heappush(heap, (-int(e - s), a + int(s), b + int(s)))
    return out


class Sieve:
    """Seeds that the benchmark may have: a bitmap by their first bits and, where they are few enough, all of them."""

    def __init__(self, bits: int, bitmap: np.ndarray, seeds: np.ndarray | None, widths: list[int]):
        self.bits, self.bitmap, self.seeds, self.widths = bits, bitmap, seeds, widths

    @classmethod
    def of(cls, seeds: DataFrame, most_sent: int) -> Sieve:
        """At most 2^27 bits and `most_sent` seeds."""
        widths = sorted(r["width"] for r in seeds.select("width").distinct().collect())
        n = seeds.count()
        exact = None
        if n <= most_sent:
            exact = np.unique(seeds.select("h").toArrow().column("h").to_numpy().view(np.uint64))
        bits = min(27, max(16, (16 * n).bit_length()))
        place = F.shiftrightunsigned("h", 64 - bits)
        words = seeds.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, int(shiftrightunsigned(h, {64 - bits}) & 63))")).alias("mask")).toArrow()
        bitmap = np.zeros(1 << (bits - 6), np.uint64)
        bitmap[words.column("word").to_numpy()] = words.column("mask").to_numpy().view(np.uint64)
        return cls(bits, bitmap, exact, widths)

    def hits(self, x: np.ndarray) -> np.ndarray:
        """Distinct seeds of a text that the sieve lets through."""
        out = [np.zeros(0, np.uint64)]
        for width in self.widths:
            h = karp_rabin(x, width)
            place = h >> np.uint64(64 - self.bits)
            h = np.unique(h[(self.bitmap[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1])
            out.append(h if self.seeds is None or not len(self.seeds) else h[self.seeds[np.minimum(np.searchsorted(self.seeds, h), len(self.seeds) - 1)] == h])
        return np.concatenate(out)


def _items(batches):
    hasher = WordHasher()
    for b in batches:
        x = [hasher(tokens_of(t)) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array([len(t) for t in x], pa.int64()), pa.array([t.tobytes() for t in x], pa.binary())], names=["item_id", "n", "tokens"])


def _seeds(min_match: int):
    def run(batches):
        for b in batches:
            for key, n, tokens in zip(*(b.column(c).to_pylist() for c in ("key", "n", "tokens"))):
                width = min(n, min_match)
                h = karp_rabin(np.frombuffer(tokens, np.uint64), width).view(np.int64)
                yield pa.RecordBatch.from_pydict({"h": h, "key": np.full(len(h), key), "at": np.arange(len(h)), "width": np.full(len(h), width), "n": np.full(len(h), n)})

    return run


def _suspects(sieve):
    def run(batches):
        hasher, sift = WordHasher(), sieve.value
        for b in batches:
            rows = []
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                x = hasher(tokens_of(t))
                h = sift.hits(x)
                if len(h):
                    rows.append((d, x.tobytes(), h.view(np.int64).tolist()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.binary(), pa.list_(pa.int64())))], names=["doc_id", "tokens", "hs"])

    return run


def _tiled(min_match: int, threshold: float):
    schema = pa.schema([(c.split()[0], pa.int64()) for c in RESULT.split(", ")])

    def run(batches):
        for b in batches:
            out = []
            for d, item_id, x, y in zip(*(b.column(c).to_pylist() for c in ("doc_id", "item_id", "item", "tokens"))):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(x) < min_match:
                    found = runs(x, y, len(x))[:1]
                else:
                    found = tiles(x, y, min_match)
                covered = sum(n for _, _, n in found)
                if found and covered >= threshold * len(x):
                    out.append((d, item_id, len(x), covered, len(found)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, threshold: float = 0.5, most_sent: int = 2_000_000) -> DataFrame:
    """doc_id, item_id, item_tokens, covered_tokens, tiles: one row for each document and item that it holds.

    Beyond `most_sent` seeds (16 MB) tasks get a bitmap of 16 MB alone, and the join does what it can't tell.
    """
    spark, at = docs.sparkSession, scratch_dir(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(_items, "item_id long, n long, tokens binary").where("n > 0")
    items = save(items.withColumn("key", F.monotonically_increasing_id()), f"{at}-items")
    seeds = save(items.select("key", "n", "tokens").mapInArrow(_seeds(min_match), "h long, key long, at long, width long, n long"), f"{at}-seeds")
    sieve = spark.sparkContext.broadcast(Sieve.of(seeds, most_sent))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    suspects = save(texts.mapInArrow(_suspects(sieve), "doc_id long, tokens binary, hs array<long>").withColumn("uid", F.monotonically_increasing_id()), f"{at}-suspects")
    met = suspects.select("uid", F.explode("hs").alias("h")).join(seeds, "h").groupBy("uid", "key").agg(F.first("n").alias("n"), F.first("width").alias("width"), F.array_sort(F.collect_set("at")).alias("ats"))
    # Tokens of the item within any shared seed.
    steps = F.transform("ats", lambda x, i: F.coalesce(F.least(F.col("width"), F.get("ats", i + 1) - x), F.col("width")))
    pairs = met.where(F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x) >= F.lit(threshold) * F.col("n")).select("uid", "key")
    both = suspects.select("uid", "doc_id", "tokens").join(pairs, "uid").join(items.select("key", "item_id", F.col("tokens").alias("item")), "key")
    out = save(both.select("doc_id", "item_id", "item", "tokens").mapInArrow(_tiled(min_match, threshold), RESULT), f"{at}-leaks")
    remove(spark, *(f"{at}-{x}" for x in ("items", "seeds", "suspects")))
    sieve.unpersist()
    return out
