"""Top hits of one term without scoring all: a directory of the postings says how good each stretch of them can be.

Postings sorted by (term, key) are cut into chunks of up to `CHUNK` keys. A chunk's row holds its first and last key, how
many keys it has, and those pairs of (tf, len) that no other of its pairs beats, so that its best score is known exactly
for any mean length. Chunks are read best first, and among equals by key, in growing waves, until the last hit found is
better than all that unread chunks hold. Chunks of rows that tombstones took back since only promise too much.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .. import constants as K
from .. import scratch
from ..functions import scalars
from . import postings

CHUNK = 256
#: Rows that a task holds while it cuts them.
ROWS_AT_ONCE = 100_000
#: Chunks that one wave reads at most.
MOST_RANGES = 500


def chunks(found: DataFrame, lens: DataFrame) -> DataFrame:
    """term, first, last, keys, tfs, lens of postings (term, key) and lengths (key, len). A frequent term lies in many partitions."""
    spark = found.sparkSession
    total = found.count()
    n = scratch.partitions(spark, total)
    tf = found.select("term", "key").repartition(n, "key").groupBy("key", "term").agg(F.count("*").alias("tf"))  # the join needs no other shuffle
    rows = tf.join(lens.select("key", "len").repartition(n, "key"), "key").select("term", "key", "tf", F.col("len").cast("long").alias("len"))
    kind = rows.schema["key"].dataType

    def run(batches):
        held, rows_held = [], 0
        for batch in batches:
            if len(batch):
                held.append(batch)
                rows_held += len(batch)
            if rows_held >= ROWS_AT_ONCE:
                one, rest = cut(held, False)
                held, rows_held = rest.to_batches() if len(rest) else [], len(rest)
                yield from one.to_batches()
        if held:
            yield from cut(held, True)[0].to_batches()

    def cut(batches, last):
        """The chunks of these rows, and the rows that wait: those of the last term that fill no chunk yet, unless they are the last."""
        held = pa.Table.from_batches(batches).combine_chunks()
        term = held["term"].combine_chunks().dictionary_encode()
        code, tf, size = term.indices.to_numpy(), held["tf"].to_numpy(), held["len"].to_numpy()
        starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        ends = np.r_[starts[1:], len(code)]
        out, done = [], 0
        for a, b in zip(starts.tolist(), ends.tolist()):
            for i in range(a, b, CHUNK):
                j = min(i + CHUNK, b)
                if not last and b == len(code) and j - i < CHUNK:
                    break
                order = np.lexsort((size[i:j], -tf[i:j])) + i  # by falling tf: a pair counts if it is shorter than all before
                least = np.minimum.accumulate(size[order])
                kept = order[np.r_[True, size[order][1:] < least[:-1]]]
                out.append((i, j - 1, j - i, tf[kept].tolist(), size[kept].tolist()))
                done = j
        at, ends, n, tfs, sizes = (list(c) for c in zip(*out))
        columns = [held["term"].take(at).combine_chunks(), held["key"].take(at).combine_chunks(), held["key"].take(ends).combine_chunks(), pa.array(n, pa.int64()), pa.array(tfs, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int64()))]
        return pa.Table.from_arrays(columns, schema=schema), held.slice(done)

    schema = pa.schema([("term", pa.string()), ("first", to_arrow_type(kind)), ("last", to_arrow_type(kind)), ("keys", pa.int64()), ("tfs", pa.list_(pa.int64())), ("lens", pa.list_(pa.int64()))])
    name = kind.simpleString()
    return scratch.by_range(rows, total, postings.ORDER).mapInArrow(run, f"term string, first {name}, last {name}, keys long, tfs array<long>, lens array<long>")


def score(tf: Column, size: Column, n: int, total: int, met: int) -> Column:
    """BM25, rounded to 6 places."""
    idf = F.greatest(F.log((F.lit(float(n - met)) + 0.5) / (met + 0.5)), F.lit(K.LEAST_IDF))
    return F.round(idf * tf * (K.K1 + 1) / (tf + K.K1 * (1 - K.B + K.B * size / (total / n))), 6)


def search(found: DataFrame, lens: DataFrame, directory: DataFrame, query: str, limit: int, n: int, total: int, met: int | None = None, where: Column | None = None, first_wave: int | None = None) -> tuple[DataFrame, dict]:
    """(key, score as `postings.search` gives them for a query of one term; chunks in all and read). met: rows with the term, if chunks also hold dead ones."""
    (term,) = scalars.tokens(query)
    of_term = directory.where(F.col("term") == term)
    counted = of_term.agg(F.count("*").alias("chunks"), F.coalesce(F.sum("keys"), F.lit(0)).alias("keys")).first()
    met, seen = counted["keys"] if met is None else met, {"chunks": counted["chunks"], "read": 0}
    nothing = lens.limit(0).select("key", F.lit(0.0).alias("score"))
    if not met:
        return nothing, seen
    # The same as every pair's score: scores grow with tf and fall with len, so pairs that are beaten don't matter.
    best = F.array_max(F.zip_with("tfs", "lens", lambda tf, size: score(tf, size, n, total, met)))
    promised = of_term.select("first", "last", best.alias("best"))
    top, wave, least, last = [], first_wave or limit, None, None
    while True:
        left = promised
        if last:  # chunks are read in this order, so unread ones come after the last one
            left = left.where((F.col("best") < last[0]) | (F.col("best") == last[0]) & ((F.col("first") > F.lit(last[1])) | (F.col("first") == F.lit(last[1])) & (F.col("last") > F.lit(last[2]))))
        if least:
            left = left.where((F.col("best") > least[0]) | (F.col("best") == least[0]) & (F.col("first") < F.lit(least[1])))
        rows = left.orderBy(F.desc("best"), "first", "last").limit(wave).collect()
        if not rows:
            break
        last = rows[-1]["best"], rows[-1]["first"], rows[-1]["last"]
        seen["read"] += len(rows)
        within = reduce(or_, ((F.col("key") >= F.lit(r["first"])) & (F.col("key") <= F.lit(r["last"])) for r in rows))
        hits = found.where((F.col("term") == term) & within)
        hits = hits if where is None else hits.where(where)
        tf = hits.groupBy("key").agg(F.count("*").alias("tf"))
        got = tf.join(lens.where(within), "key").select("key", score(F.col("tf"), F.col("len"), n, total, met).alias("score")).orderBy(F.desc("score"), "key").limit(limit).collect()
        top = sorted({*top, *((r["key"], r["score"]) for r in got)}, key=lambda x: (-x[1], x[0]))[:limit]
        if len(top) == limit:
            least = top[-1][1], top[-1][0]
        wave = min(4 * wave, MOST_RANGES)
    return found.sparkSession.createDataFrame(top, nothing.schema) if top else nothing, seen

