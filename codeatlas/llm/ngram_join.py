"""Jaccard self-join of word n-gram sets, exact, by adaptive multi-match prefixes.

A node is a distinct n-gram set; copies of a set share its node. With threshold q, a linked partner of a set of n
n-grams shares at least ceil(q n) of them, so:

1. *Screen*: a node of which more than n - ceil(q n) n-grams occur in no other node has no partner. One packed pass
   counts such n-grams (for long texts over a fixed quarter of the n-gram space, which can only spare a node).
2. *Prefixes*: the survivors' n-grams are ordered by (document frequency, hash). The l-prefix of a node holds its first
   n - ceil(q n) + l n-grams; two linked nodes share at least min(l, l') n-grams of their prefixes. The smaller one's prefix may
   be shorter, as a partner of n n-grams or more shares ceil(2 q n / (1 + q)). Each node takes the l of least estimated cost: postings met in the prefix, plus `weight` times the candidates that can share l of them.
3. *Hubs*: in each posting list the node with the fewest unshared n-grams is the hub; each node is verified against the
   hub with which it shares most, and a hub against all that it meets. Verified links are merged into components.
4. *Rest*: pairs of different components that share enough prefix n-grams, and could share enough n-grams by what each has
   alone and by what each shares with their common hub, are verified. So no link between components is lost, and pairs inside one are never made.
   In each posting list these bounds are first tried between kinds of nodes (hub, size, n-grams alone and shared with the hub), so that a
   list of many like nodes, such as those of one common passage, is no list of pairs.

Buckets of n-grams, chunks of documents and Arrow batches are bounded by their n-grams or bytes, not by documents.

Null or empty texts have no n-grams and link with nothing. Rows without doc_id take no part: their component_id is
null. Repeated rows and equal texts share a node; a doc_id given to two texts stands in both nodes. Extra columns are
not read; an empty table gives an empty result. N-grams and nodes are known by 64-bit hashes: among m nodes, a false
merge has a chance of about m * m / 3.7e19.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_AZ, WordHasher, mix, partitions, remove, save, scratch_dir, shingle_hashes, small_batches

#: Texts below LONG n-grams are screened by all their n-grams, longer ones by those whose hash is a multiple of 4.
LONG = 256
#: Documents packed together: so many at most, and of so many bytes of text or n-grams (one longer document is a chunk).
CHUNK, CHUNK_BYTES = 1000, 8_000_000
#: Bytes of text for each n-gram, about.
BYTES_PER_GRAM = 6
DEALT = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("ids", pa.binary()), ("runs", pa.binary()), ("tokens", pa.binary()), ("owned", pa.int64()), ("once", pa.int64())])
DEALT_DDL = "bucket int, chunk long, ids binary, runs binary, tokens binary, owned long, once long"


def shared_at_least(n, num: int, den: int):
    """ceil(num / den * n)"""
    return -(-num * n // den)


def ngram_set(text: bytes, hasher: WordHasher, size: int) -> np.ndarray:
    return np.unique(shingle_hashes(hasher(text.translate(LOWER_AZ).split()), size))


def node_of(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - 2**63


def deal(chunk: int, nodes: np.ndarray, owners: np.ndarray, owned: np.ndarray, once: np.ndarray, twice: np.ndarray, buckets: int):
    """Rows for each bucket of n-grams: those with an owner, those only known to be there, and those known to be there twice."""
    buckets = np.uint64(buckets)
    order = np.argsort(owned % buckets, kind="stable")  # keeps owners ascending in a bucket
    owned, owners = owned[order], owners[order]
    once, twice = (x[np.argsort(x % buckets)] for x in (once, twice))
    edges = [np.searchsorted(x % buckets, np.arange(int(buckets) + 1, dtype=np.uint64)) for x in (owned, once, twice)]
    for b in range(int(buckets)):
        (i, j), (k, m), (p, q) = ((int(e[b]), int(e[b + 1])) for e in edges)
        if j - i + m - k + q - p:
            at, runs = np.unique(owners[i:j], return_counts=True)
            yield b, chunk, nodes[at].tobytes(), runs.astype(np.int32).tobytes(), owned[i:j].tobytes() + once[k:m].tobytes() + twice[p:q].tobytes(), j - i, m - k


def task_chunk(k: int) -> int:
    from pyspark import TaskContext

    return (TaskContext.get().partitionId() << 20) | k


def chunks(batches, column: str):
    """Slices of batches, bounded by CHUNK and CHUNK_BYTES of a column."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(b):
            done = size[at - 1] if at else 0
            end = min(at + CHUNK, max(at + 1, int(np.searchsorted(size, done + CHUNK_BYTES, "right"))))
            yield b.slice(at, end - at)
            at = end


def as_batches(rows, schema: pa.Schema, most: int = 4000):
    held: list = []
    for r in rows:
        held.append(r)
        if len(held) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def owned_counts(rows) -> tuple[np.ndarray, np.ndarray, list]:
    """Distinct n-grams of a bucket, in how many nodes they occur (2 stands for more where a chunk says so), each row's owned n-grams."""
    parts, extra = [], []
    for tokens, owned, once in rows:
        t = np.frombuffer(tokens, np.uint64)
        parts.append(t)
        extra.append(t[owned + once :])
    all_tokens = np.concatenate(parts + extra)
    known, n = np.unique(all_tokens, return_counts=True)
    return known, n, [p[:o] for p, (_, o, _) in zip(parts, rows)]


def screen_pass(docs: DataFrame, size: int, buckets: int, num: int, den: int) -> DataFrame:
    """One pass over the texts: bucket -1 has each document's doc_id, set size and node; the others what the screen needs."""

    def run(batches):
        hasher = WordHasher()
        for k, b in enumerate(chunks(batches, "text")):
            chunk, sets, sizes, names = task_chunk(k), {}, [], []
            for t in b.column("text").cast(pa.binary()).to_pylist():
                s = ngram_set(t or b"", hasher, size)
                names.append(node_of(s))
                sizes.append(len(s))
                if len(s):
                    sets.setdefault(names[-1], s)
            yield from as_batches([(-1, chunk, np.array([x for x in b.column("doc_id").to_pylist()], np.int64).tobytes(), np.array(sizes, np.int64).tobytes(), np.array(names, np.int64).tobytes(), len(sizes), 0)], DEALT)
            if not sets:
                continue
            nodes = np.array(list(sets), np.int64)
            shown, owners, counted = [], [], []
            for i, s in enumerate(sets.values()):
                quarter = s % np.uint64(4) == 0
                shown.append(s if len(s) < LONG else s[quarter])
                # Partners may be longer by den / num; only what all of them show is counted.
                counted.append(np.ones(len(s), bool) if len(s) * den < LONG * num else quarter if len(s) < LONG else np.ones(len(shown[-1]), bool))
                owners.append(np.full(len(shown[-1]), i, np.int64))
            t, o, c = map(np.concatenate, (shown, owners, counted))
            known, back, n = np.unique(t, return_inverse=True, return_counts=True)
            alone = n[back] == 1
            yield from as_batches(deal(chunk, nodes, o[alone & c], mix(t[alone & c]), mix(t[alone & ~c]), mix(known[n > 1]), buckets), DEALT)

    return docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, DEALT_DDL)


def screened(dealt: DataFrame) -> DataFrame:
    """node, alone: how many counted n-grams of the node occur in no other."""
    import pandas as pd

    def bucket(pdf: pd.DataFrame) -> pd.DataFrame:
        known, n, owned = owned_counts(list(zip(pdf["tokens"], pdf["owned"], pdf["once"])))
        single, out = known[n == 1], []
        for t, ids, runs in zip(owned, pdf["ids"], pdf["runs"]):
            at = np.searchsorted(single, t)
            hit = (at < len(single)) & (single[np.minimum(at, max(0, len(single) - 1))] == t) if len(single) else np.zeros(len(t), bool)
            runs = np.frombuffer(runs, np.int32)
            who = np.repeat(np.arange(len(runs)), runs)
            n_alone = np.bincount(who[hit], minlength=len(runs)).astype(np.int32)
            out.append((np.frombuffer(ids, np.int64)[n_alone > 0].tobytes(), n_alone[n_alone > 0].tobytes()))
        return pd.DataFrame({"chunk": pdf["chunk"], "ids": [x for x, _ in out], "runs": [x for _, x in out]})

    def chunk(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.frombuffer(b"".join(pdf["ids"]), np.int64)
        known, back = np.unique(ids, return_inverse=True)
        return pd.DataFrame({"node": known, "alone": np.bincount(back, np.frombuffer(b"".join(pdf["runs"]), np.int32), len(known)).astype(np.int64)})

    by_bucket = dealt.where("bucket >= 0").groupBy("bucket").applyInPandas(bucket, "chunk long, ids binary, runs binary")
    return by_bucket.groupBy("chunk").applyInPandas(chunk, "node long, alone long")


def sets_of(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """node, n, tokens of the nodes in `wanted` (node, rep), made again from the text of one document each."""

    def run(batches):
        hasher = WordHasher()
        for c in chunks(batches, "text"):
            sets = [ngram_set(t or b"", hasher, size) for t in c.column("text").cast(pa.binary()).to_pylist()]
            rows = [(w, len(s), s.tobytes()) for s, w in zip(sets, c.column("node").to_pylist()) if node_of(s) == w]
            yield from as_batches(rows, schema)

    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("tokens", pa.binary())])
    found = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(wanted, "rep").select("node", "text")
    return found.mapInArrow(run, "node long, n long, tokens binary").dropDuplicates(["node"])


def prefixes(sets: DataFrame, buckets: int, num: int, den: int, weight: float, most_l: int) -> DataFrame:
    """token, node, n, alone, l, near (whether it is in the shorter prefix, for partners that are no smaller): the postings of each node's chosen prefix that can be met in another node."""
    import pandas as pd

    def run(batches):
        for k, b in enumerate(chunks(batches, "tokens")):
            nodes = np.array(b.column("node").to_pylist(), np.int64)
            sets = [np.frombuffer(x, np.uint64) for x in b.column("tokens").to_pylist()]
            owners = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            none = np.zeros(0, np.uint64)
            yield from as_batches(deal(task_chunk(k), nodes, owners, mix(np.concatenate([none, *sets])), none, none, buckets), DEALT)
            sizes = np.array([len(s) for s in sets], np.int32)
            yield from as_batches([(-1, task_chunk(k), nodes.tobytes(), sizes.tobytes(), b"", 0, 0)], DEALT)

    def bucket(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["bucket"].iloc[0] < 0:
            return pd.DataFrame({"chunk": pdf["chunk"], "ids": pdf["ids"], "runs": pdf["runs"], "tokens": [b""] * len(pdf), "df": [b""] * len(pdf)})
        known, n, owned = owned_counts(list(zip(pdf["tokens"], pdf["owned"], pdf["once"])))
        out = []
        for t, ids, runs in zip(owned, pdf["ids"], pdf["runs"]):
            df = n[np.searchsorted(known, t)]
            who = np.repeat(np.frombuffer(ids, np.int64), np.frombuffer(runs, np.int32))
            out.append((who[df > 1].tobytes(), b"", t[df > 1].tobytes(), df[df > 1].astype(np.int64).tobytes()))
        return pd.DataFrame({"chunk": pdf["chunk"], **{c: [x[i] for x in out] for i, c in enumerate(("ids", "runs", "tokens", "df"))}})

    def chunk(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes: dict[int, int] = {}
        for ids, runs in zip(pdf["ids"], pdf["runs"]):
            if runs:
                sizes.update(zip(np.frombuffer(ids, np.int64).tolist(), np.frombuffer(runs, np.int32).tolist()))
        body = [(i, t, d) for i, r, t, d in zip(pdf["ids"], pdf["runs"], pdf["tokens"], pdf["df"]) if not r]
        who, tok, df = (np.frombuffer(b"".join(x[k] for x in body), kind) for k, kind in ((0, np.int64), (1, np.uint64), (2, np.int64)))
        order = np.lexsort((tok, df, who))
        who, tok, df = who[order], tok[order], df[order]
        first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]]) if len(who) else np.zeros(0, np.int64)
        out = []
        for i, j in zip(first.tolist(), np.r_[first[1:], len(who)].tolist()):
            n = sizes[int(who[i])]
            alone = n - (j - i)
            one = n - shared_at_least(n, num, den) + 1 - alone  # length of what is left of the 1-prefix
            if one < 1:
                continue
            met = np.cumsum(df[i:j])
            ls = np.arange(1, min(most_l, j - i - one + 1) + 1)
            s = met[one + ls - 2]
            best = int(np.argmin(s + weight * s / ls))
            m = one + best
            # A partner of the same size or a larger one shares more, so that a shorter prefix will do.
            near = n - shared_at_least(2 * n, num, num + den) + best + 1 - alone
            out.append((tok[i : i + m].astype(np.int64), np.full(m, who[i]), np.full(m, n), np.full(m, alone), np.full(m, best + 1), (np.arange(m) < near).astype(np.int64)))
        return pd.DataFrame({c: np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64) for k, c in enumerate(("token", "node", "n", "alone", "l", "near"))})

    dealt = sets.select("node", "tokens").mapInArrow(run, DEALT_DDL)
    by_bucket = dealt.groupBy("bucket", F.when(F.col("bucket") < 0, F.col("chunk"))).applyInPandas(bucket, "chunk long, ids binary, runs binary, tokens binary, df binary")
    return by_bucket.groupBy("chunk").applyInPandas(chunk, "token long, node long, n long, alone long, l long, near long")


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) with how many n-grams they share and whether they reach the threshold."""

    def run(batches):
        for b in batches:
            common, keep = [], []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(x) + len(y)
                shared = both - len(np.unique(np.concatenate([x, y])))
                common.append(shared)
                keep.append(den * shared >= num * (both - shared))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(common, pa.int64()), pa.array(keep, pa.bool_())], names=["a", "b", "shared", "linked"])

    s = sets.select("node", "tokens")
    full = pairs.join(s.toDF("a", "x"), "a").join(s.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return full.mapInArrow(run, "a long, b long, shared long, linked boolean")


def components(links: DataFrame, folder: str) -> DataFrame:
    """node, comp (its component's smallest node) of all nodes in `links` (a, b): neighbours' minima and pointer jumping, a table for each round."""
    spark = links.sparkSession
    both = links.select("a", "b").union(links.select("b", "a")).distinct()
    labels, k, old = save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("comp")), f"{folder}-0"), 0, None
    while True:
        k += 1
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        up = labels.toDF("comp", "above")
        new = labels.join(up, "comp").join(near, "node").select("node", F.least("above", "near").alias("comp"), (F.least("above", "near") < F.col("comp")).alias("moved"))
        new = save(new, f"{folder}-{k}")
        moved = new.where("moved").limit(1).count()
        remove(spark, f"{folder}-{k - 1}")
        labels = new.select("node", "comp")
        if not moved:
            return labels


def link(docs: DataFrame, size: int = 3, num: int = 9, den: int = 10, weight: float = 8.0, most_l: int = 8, grams_per_bucket: int = 1_500_000) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links of Jaccard >= num / den)."""
    with small_batches(docs.sparkSession, CHUNK):
        meta, final = _linked(docs, size, num, den, weight, most_l, grams_per_bucket)
    full = meta.where("n > 0").join(final, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    empty = meta.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    nameless = docs.where("doc_id IS NULL").select(F.lit(None).cast("long").alias("doc_id"), "text").mapInArrow(_sizes(size), "doc_id long, n_shingles long, component_id long")
    return full.union(empty).union(nameless)


def _linked(docs: DataFrame, size: int, num: int, den: int, weight: float, most_l: int, grams_per_bucket: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, node) and (node, component_id), both as tables."""
    spark, at = docs.sparkSession, scratch_dir(docs.sparkSession)
    size_of = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(partitions(spark), size_of // BYTES_PER_GRAM // grams_per_bucket)
    dealt = save(screen_pass(docs, size, buckets, num, den), f"{at}-dealt")

    def unpack(batches):
        for b in batches:
            for ids, runs, names in zip(b.column("ids").to_pylist(), b.column("runs").to_pylist(), b.column("tokens").to_pylist()):
                yield pa.RecordBatch.from_pydict({"doc_id": np.frombuffer(ids, np.int64), "n": np.frombuffer(runs, np.int64), "node": np.frombuffer(names, np.int64)})

    meta = save(dealt.where("bucket = -1").select("ids", "runs", "tokens").mapInArrow(unpack, "doc_id long, n long, node long"), f"{at}-meta")
    nodes = meta.where("n > 0").groupBy("node", "n").agg(F.min("doc_id").alias("rep"))
    alone = screened(dealt).groupBy("node").agg(F.min("alone").alias("alone"))
    may = nodes.join(alone, "node", "left").where(f"coalesce(alone, 0) <= n - ceil({num} * n / {den})").select("node", "rep")
    sets = save(sets_of(docs, may, size), f"{at}-sets")
    remove(spark, f"{at}-dealt")
    lists = save(prefixes(sets, buckets, num, den, weight, most_l), f"{at}-lists")

    enough = lambda x, y: f"{num + den} * least({x}.n - {x}.alone, {y}.n - {y}.alone) >= {num} * ({x}.n + {y}.n)"
    hubs = lists.groupBy("token").agg(F.min(F.struct((F.col("alone") / F.col("n")).alias("share"), "node", "n", "alone")).alias("h")).select("token", "h.node", "h.n", "h.alone")
    tried = lists.alias("x").join(hubs.alias("h"), "token").where("x.node <> h.node").where(enough("x", "h")).groupBy(F.col("x.node").alias("a"), F.col("h.node").alias("b")).count()
    tried = save(tried, f"{at}-tried")
    best = tried.groupBy("a").agg(F.max_by("b", F.struct("count", F.col("b"))).alias("b"))
    # A hub that others go by is held against all hubs it meets, or one group with several hubs would stay apart.
    among = tried.join(best.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select("a", "b")
    first = save(verified(best.union(among).distinct(), sets, num, den), f"{at}-first")
    links = first.where("linked").select("a", "b")
    labels = components(links, f"{at}-c1")

    # A node's hub and what it shares with it; a hub is its own where it was tried against none.
    tried_hub = first.groupBy(F.col("a").alias("node")).agg(F.max_by("b", F.struct("shared", "b")).alias("hub"), F.max("shared").alias("in_hub"))
    marked = lists.join(tried_hub, "node", "left").withColumns({"hub": F.coalesce("hub", "node"), "in_hub": F.coalesce("in_hub", "n")})
    named = save(marked.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node")), f"{at}-named")
    # What two nodes share is in their hub and in both, or outside it and alone in neither.
    outside = lambda x: f"{x}.n - {x}.in_hub - {x}.alone"
    by_hub = f"x.hub <> y.hub OR {num + den} * (least(x.in_hub, y.in_hub) + least({outside('x')}, {outside('y')})) >= {num} * (x.n + y.n)"
    open_ = named.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("token")
    rest = named.join(open_, "token", "left_semi")
    kind = ["token", "hub", "n", "in_hub", "alone", "near"]
    kinds = rest.groupBy(*kind).agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    apart = F.expr("x.low <> x.high OR y.low <> y.high OR x.low <> y.low")
    in_prefix = F.expr("(x.n > y.n OR x.near = 1) AND (y.n > x.n OR y.near = 1)")
    met = kinds.alias("x").join(kinds.alias("y"), (F.col("x.token") == F.col("y.token")) & apart & in_prefix & F.expr(enough("x", "y")) & F.expr(by_hub))
    met = met.select("x.token", *[F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in "xy" for c in kind[1:]])
    of = lambda side: rest.select("token", *[F.col(c).alias(f"{side}_{c}") for c in (*kind[1:], "node", "comp", "l")])
    shared = of("x").join(met, ["token", *[f"x_{c}" for c in kind[1:]]]).join(of("y"), ["token", *[f"y_{c}" for c in kind[1:]]]).where("x_comp < y_comp")
    again = shared.groupBy(F.col("x_node").alias("a"), F.col("y_node").alias("b")).agg(F.count("*").alias("met"), F.min(F.least("x_l", "y_l")).alias("need")).where("met >= need").select("a", "b")
    second = save(verified(again, sets, num, den), f"{at}-second")
    labels = components(links.union(second.where("linked").select("a", "b")), f"{at}-c2")

    known = nodes.join(labels, "node", "left").select("node", "rep", F.coalesce("comp", "node").alias("comp"))
    least = known.groupBy("comp").agg(F.min("rep").alias("component_id"))
    final = save(known.join(least, "comp").select("node", "component_id"), f"{at}-final")
    remove(spark, *(f"{at}-{x}" for x in ("sets", "lists", "tried", "named", "first", "second")))
    return meta, final


def _sizes(size: int):
    def run(batches):
        hasher = WordHasher()
        for b in batches:
            n = [len(ngram_set(t or b"", hasher, size)) for t in b.column("text").cast(pa.binary()).to_pylist()]
            none = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(n, pa.int64()), none], names=["doc_id", "n_shingles", "component_id"])

    return run
