"""Hard negatives by exact search over one-dimensional distance keys.

Vectors become integers x = floor(scale * c), scores are inner products. A vector x gets one more entry, so that all have
the length of the longest one (R); then the distance of a query q (whose extra entry is 0) to x is
sqrt(|q|^2 + R^2 - 2 score): near is high. Each vector belongs to its nearest pivot, and is stored sorted by (pivot,
distance to it) in blocks of rows. By the triangle inequality, an x of key t lies at |d - t| to d + t from a query at
distance d from the pivot, so a wanted range of scores is, around each pivot, an interval of keys. A search visits the
cells of keys (a bounded directory of them is sent to tasks) in the order of that lower bound, in rounds: about 1/16 of
the rows, then 1/4, then all that the bound still admits. It ends when no unvisited cell can hold a row as good as the last
one found, so results are exact. Queries travel in blocks of neighbours. Cells are dealt to parts of a bounded size, and a
query block goes once to each part of which it visits a cell, not once to each cell.

Of rows with the same vector and label only the smallest `positives + 1` vec_ids are stored: no other can be among the
first, as they come after those at the same score. Anchors with the same vector and label are one query.

Rows with a null label, vec_id or vector, with null or non-finite entries, or with entries so large that scores could leave
64 bits take no part; nor do rows whose length is not the most frequent one (of equally frequent ones the shortest).
Repeated rows count once; rows that share a vec_id but differ are each a row and, if anchors, each an anchor. A positive
with a negative score has no negatives. An empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import blocks as groups
from . import common, whitening

#: Rounds: the share of all rows that each may visit, and the rows that it may in any case.
SHARES, AT_LEAST = (1 / 16, 1 / 4, 1.0), 8192
LOWEST, HIGHEST = -(2**62), 2**62


@dataclass
class Keys:
    """Pivots (with their extra entry), R^2, and the ends of each pivot's cells but the outermost."""

    pivots: np.ndarray
    longest: float
    ends: list[np.ndarray]

    def distances(self, x: np.ndarray, stored: bool) -> np.ndarray:
        """To each pivot, of stored vectors or of queries."""
        squares = np.einsum("ij,ij->i", x, x)
        extra = np.sqrt(np.maximum(self.longest - squares, 0)) if stored else np.zeros(len(x))
        whole = np.concatenate([x, extra[:, None]], axis=1)
        away = np.einsum("ij,ij->i", whole, whole)[:, None] + np.einsum("ij,ij->i", self.pivots, self.pivots)[None] - 2 * whole @ self.pivots.T
        return np.sqrt(np.maximum(away, 0))

    def place(self, x: np.ndarray, stored: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pivot, cell and distance of each vector; cells are numbered through all pivots."""
        d = self.distances(x, stored)
        pivot = d.argmin(axis=1)
        near = d[np.arange(len(x)), pivot]
        first = np.concatenate([[0], np.cumsum([len(e) + 1 for e in self.ends])])
        cell = np.array([first[p] + np.searchsorted(self.ends[p], t, "right") for p, t in zip(pivot, near)], np.int64)
        return pivot, cell, near


@dataclass
class Index:
    """Blocks of rows; of each cell its pivot, least and greatest key and rows; whether scores are exact as doubles with a block's place."""

    keys: Keys
    blocks: DataFrame
    cells: np.ndarray
    pivot: np.ndarray
    low: np.ndarray
    high: np.ndarray
    count: np.ndarray
    width: int
    small: bool


def vectors(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, width)


def prepare(table: DataFrame, label: Column, scale: float = 256.0) -> tuple[DataFrame, int]:
    """vec_id, label, v (packed integers), id_of (128 bits for vector and label) of the rows that take part, and the vectors' length."""
    named = table.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), "embedding").where("vec_id IS NOT NULL AND label IS NOT NULL")
    rows = whitening.integers(named, "embedding", scale)
    first = rows.select(F.size("x").alias("d")).first()
    width = first["d"] if first else 1
    most = min(2**31 - 1, math.isqrt(2**62 // width))

    def pack(batches):
        for b in batches:
            x = whitening.matrix(b.column("x"), np.int64)
            v = [r.tobytes() for r in x.astype("<i4")]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(v, pa.binary())], names=["vec_id", "label", "v"])

    fit = rows.where(F.forall("x", lambda c: (c <= most) & (c >= -most))).select("vec_id", "label", "x")
    packed = fit.mapInArrow(pack, "vec_id long, label long, v binary")
    return packed.withColumn("id_of", F.unhex(F.md5(F.concat("v", F.encode(F.col("label").cast("string"), "UTF-8"))))), width


def clusters(x: np.ndarray, most: int, rounds: int = 6) -> np.ndarray:
    """At most `most` centres of x: seeds far from one another, then a few rounds of means."""
    centres, away = [x.mean(axis=0)], np.full(len(x), np.inf)
    while len(centres) < most:
        away = np.minimum(away, ((x - centres[-1]) ** 2).sum(axis=1))
        if away.max() <= 0:
            break
        centres.append(x[away.argmax()])
    out = np.array(centres)
    for _ in range(rounds):
        near = ((x**2).sum(axis=1)[:, None] + (out**2).sum(axis=1)[None] - 2 * x @ out.T).argmin(axis=1)
        for k in np.unique(near):
            out[k] = x[near == k].mean(axis=0)
    return out


def build(rows: DataFrame, width: int, folder: str, pivots: int = 32, cells: int = 16, block: int = 1024, sample: int = 4000) -> Index | None:
    """Store `rows` (vec_id, label, v). Pivots and the cells' ends are chosen on the `sample` rows of the lowest hash; every row is stored.

    There are at most `pivots` pivots with at most `cells` cells each, and fewer where a cell would hold less than a block.
    """

    def facts(batches):
        for b in batches:
            x = vectors(b.column("v"), width).astype(np.float64)
            if len(x):
                yield pa.RecordBatch.from_pydict({"longest": [float(np.einsum("ij,ij->i", x, x).max())], "most": [float(np.abs(x).max())], "n": [len(x)]})

    top = rows.select("v").mapInArrow(facts, "longest double, most double, n long").agg(F.max("longest").alias("longest"), F.max("most").alias("most"), F.sum("n").alias("n")).first()
    if top["longest"] is None:
        return None
    pivots = min(pivots, max(1, top["n"] // block))
    cells = min(cells, max(1, top["n"] // (pivots * block)))
    drawn = groups.sample(rows.select("v", "vec_id"), F.xxhash64("v", "vec_id"), sample, top["n"], "v")
    x = vectors(drawn["v"], width).astype(np.float64)
    whole = np.concatenate([x, np.sqrt(np.maximum(top["longest"] - np.einsum("ij,ij->i", x, x), 0))[:, None]], axis=1)
    keys = Keys(clusters(whole, pivots), top["longest"], [])
    d = keys.distances(x, True)
    near = d.argmin(axis=1)
    keys.ends = [np.unique(np.quantile(d[near == p, p], np.arange(1, cells) / cells)) if (near == p).any() else np.zeros(0) for p in range(len(keys.pivots))]

    def place(batches):
        for b in batches:
            pivot, cell, t = keys.place(vectors(b.column("v"), width).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pivot, pa.int32()), pa.array(cell, pa.int32()), pa.array(t)], names=[*b.schema.names, "pivot", "cell", "t"])

    def pack(batches):
        held, rows_held = [], 0

        def flush(all_rows: bool):
            """Blocks of one cell each; without `all_rows`, the last cell's rows wait for more."""
            nonlocal held, rows_held
            whole = pa.Table.from_batches(held).combine_chunks()
            cell, n = whole["cell"].to_numpy(), len(whole)
            starts = np.concatenate([[0], np.flatnonzero(np.diff(cell)) + 1, [n]])
            done, out = 0, []
            for a, b in zip(starts, starts[1:]):
                for i in range(a, b, block):
                    j = min(i + block, b)
                    if all_rows or j - i == block or b < n:
                        one = whole.slice(i, j - i).sort_by("vec_id")  # ties within a block go by place
                        t = one["t"].to_numpy()
                        out.append((int(cell[i]), int(one["pivot"][0].as_py()), t.min(), t.max(), j - i, one["vec_id"].to_numpy().astype("<i8").tobytes(), one["label"].to_numpy().astype("<i8").tobytes(), b"".join(one["v"].to_pylist())))
                        done = j
            rest = whole.slice(done)
            held, rows_held = rest.to_batches() if len(rest) else [], len(rest)
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)

        for b in batches:
            if len(b):
                held.append(b)
                rows_held += len(b)
                if rows_held >= 8 * block:
                    yield flush(False)
        if rows_held:
            yield flush(True)

    schema = pa.schema([("cell", pa.int32()), ("pivot", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("n", pa.int64()), ("ids", pa.binary()), ("labels", pa.binary()), ("v", pa.binary())])
    placed = rows.select("vec_id", "label", "v").mapInArrow(place, "vec_id long, label long, v binary, pivot int, cell int, t double")
    kept = placed.repartitionByRange(common.partitions(rows.sparkSession), "pivot", "t", "vec_id").sortWithinPartitions("pivot", "t", "vec_id")
    blocks = common.save(kept.mapInArrow(pack, "cell int, pivot int, low double, high double, n long, ids binary, labels binary, v binary"), f"{folder}-blocks")
    held = blocks.groupBy("cell").agg(F.first("pivot").alias("pivot"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).orderBy("cell").collect()  # a row for each cell
    column = lambda name, kind: np.array([r[name] for r in held], kind)
    small = width * top["most"] ** 2 * 2 * block < 2**53
    return Index(keys, blocks, column("cell", np.int64), column("pivot", np.int64), column("low", float), column("high", float), column("n", np.int64), width, small)


def query_blocks(queries: DataFrame, index: Index, size: int = 256) -> DataFrame:
    """Blocks of about `size` queries (q, label, v) of one pivot: qb, qs (q of each, in order), v, labels."""
    keys, width = index.keys, index.width

    def place(batches):
        for b in batches:
            pivot, _, _ = keys.place(vectors(b.column("v"), width).astype(np.float64), False)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pivot, pa.int32())], names=[*b.schema.names, "pivot"])

    def pack(batches):
        for b in batches:
            for r in b.to_pylist():
                held = r["held"]
                yield pa.RecordBatch.from_pydict({"qb": [r["qb"]], "qs": [[x["q"] for x in held]], "v": [b"".join(x["v"] for x in held)], "labels": [np.array([x["label"] for x in held], "<i8").tobytes()]}, schema)

    schema = pa.schema([("qb", pa.int64()), ("qs", pa.list_(pa.binary())), ("v", pa.binary()), ("labels", pa.binary())])
    placed = queries.select("q", "label", "v").mapInArrow(place, "q binary, label long, v binary, pivot int")
    parts = {r["pivot"]: -(-r["count"] // size) for r in placed.groupBy("pivot").count().collect()}  # a row for each pivot
    most = max(parts.values(), default=1)
    of = F.element_at(F.create_map(*[F.lit(x) for kv in parts.items() for x in kv]), F.col("pivot")) if parts else F.lit(1)
    number = F.col("pivot").cast("long") * most + F.pmod(F.xxhash64("q"), of.cast("long"))
    grouped = placed.groupBy(number.alias("qb")).agg(F.sort_array(F.collect_list(F.struct("q", "label", "v"))).alias("held"))
    return grouped.mapInArrow(pack, "qb long, qs array<binary>, v binary, labels binary")


def admits(near: np.ndarray, squares: np.ndarray, longest: float, lowest: np.ndarray, highest: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Lower bounds of distance where a key interval may hold a score in [lowest, highest], else infinity. Rows are wanted ranges, columns intervals; `near`: distances to the intervals' pivots."""
    slack = 1e-9 * (squares + longest) + 1e-9
    far = np.sqrt(np.maximum(squares + longest - 2.0 * lowest + slack, 0))
    close = np.sqrt(np.maximum(squares + longest - 2.0 * np.minimum(highest, (squares + longest) / 2) - slack, 0))
    least = np.maximum(0, np.maximum(near - high, low - near))
    fine = 1e-7 * np.sqrt(squares + longest)[:, None] + 1e-9  # keys near 0 are no more exact than that
    return np.where((least - fine <= far[:, None]) & (near + high + fine >= close[:, None]), least, np.inf)


def best(scores: np.ndarray, fits: np.ndarray, k: int, small: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the first k fitting columns of each row, by falling score and then by place."""
    n = scores.shape[1]
    if small:
        key = np.where(fits, scores * (2 * n) + (n - 1 - np.arange(n)), -np.inf)
        at = np.argpartition(-key, k - 1, axis=1)[:, :k] if n > k else np.tile(np.arange(n), (len(key), 1))
    else:
        at = np.lexsort((np.broadcast_to(np.arange(n), scores.shape), -scores, ~fits), axis=1)[:, :k]
    row = np.repeat(np.arange(len(scores)), at.shape[1])
    column = at.ravel()
    held = fits[row, column]
    return row[held], column[held]


def search(index: Index, wanted: DataFrame, k: int, same: bool, folder: str) -> DataFrame:
    """qb, item, score, vec_id, rank of the first k rows of each wanted range.

    wanted: qb, v and labels (packed) of a block of queries; of (which query), lowest and highest (scores) of each range, as
    arrays; `same`: rows of the query's label, else rows of another one.
    """
    keys, cells, pivot, low, high, count, width, small = index.keys, index.cells, index.pivot, index.low, index.high, index.count, index.width, index.small
    longest, total = keys.longest, int(count.sum())
    names = ["qb", "v", "labels", "of", "lowest", "highest"]
    longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
    schema = pa.schema([("qb", pa.int64()), ("v", pa.binary()), ("labels", pa.binary()), ("of", ints), ("lowest", longs), ("highest", longs), ("seen", ints), ("cells", ints), ("parts", ints)])
    shape = "qb long, v binary, labels binary, of array<int>, lowest array<long>, highest array<long>, seen array<int>, cells array<int>, parts array<int>"
    spark = wanted.sparkSession
    first, splits = groups.parts(count.tolist(), groups.rows_of_part(total, width, common.partitions(spark)))
    dealt = spark.createDataFrame([(int(c), int(f), int(n)) for c, f, n in zip(cells, first, splits)], "cell int, first int, splits int")  # a row for each cell

    def ranges(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(r["of"], np.int64), np.array(r["lowest"], np.int64), np.array(r["highest"], np.int64)

    def choose(allowed: float):
        def run(batches):
            for b in batches:
                for r in b.to_pylist():
                    q = np.frombuffer(r["v"], "<i4").reshape(-1, width).astype(np.float64)
                    of, lowest, highest = ranges(r)
                    got: dict[int, list[int]] = {}
                    for f in r["found"] or ():
                        got.setdefault(f["item"], []).append(f["score"])
                    for item, scores in got.items():
                        if len(scores) >= k:
                            lowest[item] = max(lowest[item], min(scores))
                    squares = np.einsum("ij,ij->i", q, q)[of]
                    bound = admits(keys.distances(q, False)[of][:, pivot], squares, longest, lowest.astype(float), highest.astype(float), low, high).min(axis=0, initial=np.inf)
                    seen = set(r["seen"] or ())
                    todo = [c for c in np.argsort(bound, kind="stable").tolist() if bound[c] < np.inf and c not in seen]
                    ends = np.cumsum(count[todo]) if todo else np.zeros(0)
                    todo = todo[: int(np.searchsorted(ends, allowed)) + 1]
                    visits = np.unique(np.concatenate([np.arange(first[c], first[c] + splits[c]) for c in todo])) if todo else []
                    out = {c: [r[c]] for c in names} | {"lowest": [lowest], "seen": [sorted(seen.union(todo))], "cells": [cells[todo].tolist() if todo else []], "parts": [visits]}
                    yield pa.RecordBatch.from_pydict(out, schema)

        return run

    def merged(held):
        """The first k of each range, and the ranges' lowest scores that still count."""
        item, s, i = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((i, -s, item))
        item, s, i = item[order], s[order], i[order]
        starts = np.flatnonzero(np.r_[True, item[1:] != item[:-1]])
        place = np.arange(len(item)) - np.repeat(starts, np.diff(np.r_[starts, len(item)]))
        full = place == k - 1
        return (item[place < k], s[place < k], i[place < k]), (item[full], s[full])

    def score(asked: pa.Table, stored: pa.Table) -> pa.Table:
        kept = [(r, np.frombuffer(r["bv"], "<i4").reshape(-1, width).astype(np.float64 if small else np.int64)) for r in stored.select(["cell", "pivot", "low", "high", "ids", "blabels", "bv"]).to_pylist()]
        out = []
        for b in asked.to_batches(1):
            (r,) = b.to_pylist()
            q = np.frombuffer(r["v"], "<i4").reshape(-1, width).astype(np.float64)
            exact = q if small else q.astype(np.int64)
            of, lowest, highest = ranges(r)
            near, squares, labels, visited = keys.distances(q, False), np.einsum("ij,ij->i", q, q)[of], np.frombuffer(r["labels"], "<i8")[of], set(r["cells"])
            held, rows_held = [], 0
            for block, x in kept:
                if block["cell"] not in visited:
                    continue
                bound = admits(near[of, block["pivot"]][:, None], squares, longest, lowest.astype(float), highest.astype(float), np.array([block["low"]]), np.array([block["high"]]))
                items = np.flatnonzero(bound[:, 0] < np.inf)
                s = (exact @ x.T)[of[items]]
                fits = (s >= lowest[items][:, None]) & (s <= highest[items][:, None])
                fits &= (labels[items][:, None] == np.frombuffer(block["blabels"], "<i8")[None]) == same
                some = np.flatnonzero(fits.any(axis=1))
                if not len(some):
                    continue
                row, column = best(s[some], fits[some], k, small)
                held.append((items[some[row]], s[some[row], column].astype(np.int64), np.frombuffer(block["ids"], "<i8")[column]))
                rows_held += len(row)
                if rows_held >= 4 * k * len(of):
                    one, (item, least) = merged(held)
                    held, rows_held = [one], len(one[0])
                    lowest[item] = np.maximum(lowest[item], least)
            if held:
                item, s, i = merged(held)[0]
                out.append((np.full(len(item), r["qb"], np.int64), item.astype(np.int32), s, i))
        whole = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, t) for t in (np.int64, np.int32, np.int64, np.int64)]
        return pa.table([pa.array(c) for c in whole], names=["qb", "item", "score", "vec_id"])

    state = wanted.select(*names, F.lit(None).cast("array<int>").alias("seen"), F.lit(None).cast("array<struct<item:int,score:bigint>>").alias("found"))
    found = None
    blocks = index.blocks.select("cell", "pivot", "low", "high", "ids", F.col("labels").alias("blabels"), F.col("v").alias("bv")).join(F.broadcast(dealt), "cell")
    blocks = blocks.withColumn("part", F.col("first") + F.pmod(F.xxhash64("ids"), F.col("splits").cast("long")).cast("int")).drop("first", "splits")
    for n, share in enumerate(SHARES):
        allowed = total if share >= 1 else max(AT_LEAST, share * total)
        state = common.save(state.mapInArrow(choose(allowed), shape), f"{folder}-{n}-state")
        size = state.where("size(cells) > 0").agg(F.count("*").alias("n"), F.sum(F.length("v") + F.size("of") * F.lit(24)).alias("bytes")).first()
        if not size["n"]:
            break
        asked = state.select(*names, "cells", F.explode("parts").alias("part"))
        with common.small_batches(spark, 64):
            got = groups.meet(asked, blocks, "qb", -(-size["bytes"] // groups.ASKED), score, "qb long, item int, score long, vec_id long")
            got = got if found is None else got.unionByName(found.drop("rank"))
            rank = F.row_number().over(Window.partitionBy("qb", "item").orderBy(F.desc("score"), "vec_id"))
            found = common.save(got.withColumn("rank", rank).where(F.col("rank") <= k), f"{folder}-{n}-found")
        if share >= 1:
            break
        lists = found.groupBy("qb").agg(F.collect_list(F.struct("item", "score")).alias("found"))  # k for each range of a block of queries
        state = state.select(*names, "seen").join(lists, "qb", "left")
    return found if found is not None else state.sparkSession.createDataFrame([], "qb long, item int, score long, vec_id long, rank int")


def hundredths(score: Column, part: int, up: int) -> Column:
    """part / 100 of a score that isn't negative, as a whole number: rounded down, or up if `up` is 99. No step leaves a long."""
    rest = score % 100
    whole = lambda c: F.call_function("div", c, F.lit(100).cast("long"))
    return whole(score) * part + whole(rest * part + up)


def mine(table: DataFrame, label: Column | None = None, anchors: Column | None = None, positives: int = 5, negatives: int = 3, lower: int = 50, upper: int = 95, **options) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For each anchor (a condition on vec_id) and each of its first `positives` other rows of the same label, the first
    `negatives` rows of another label whose score is between `lower` and `upper` hundredths of the positive's.
    """
    spark = table.sparkSession
    folder = f"{common.scratch_dir(spark)}-negatives"
    shape = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows, width = prepare(table, F.col("label") if label is None else label)
    rows = rows.dropDuplicates(["id_of", "vec_id"])
    place = F.row_number().over(Window.partitionBy("id_of").orderBy("vec_id"))
    kept = common.save(rows.withColumn("place", place).where(F.col("place") <= positives + 1).drop("place", "id_of"), f"{folder}-rows")
    index = build(kept, width, folder, **options)
    if index is None:
        return spark.createDataFrame([], shape)
    asking = common.save(rows.where(F.col("vec_id") % 50 == 0 if anchors is None else anchors).select(F.col("id_of").alias("q"), "vec_id", "label", "v"), f"{folder}-anchors")
    queries = asking.groupBy("q").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.when(F.count("*") == 1, F.min("vec_id")).alias("only"))
    blocks = common.save(query_blocks(queries, index), f"{folder}-queries")
    every = F.sequence(F.lit(0), F.size("qs") - 1)
    whole = blocks.select("qb", "v", "labels", every.alias("of"), F.transform(every, lambda _: F.lit(LOWEST).cast("long")).alias("lowest"), F.transform(every, lambda _: F.lit(HIGHEST).cast("long")).alias("highest"))
    first = search(index, whole, positives + 1, True, f"{folder}-positives")
    names = blocks.select("qb", F.posexplode("qs").alias("item", "q")).join(queries.select("q", "only"), "q")
    first = common.save(first.join(names, ["qb", "item"]).where("only IS NULL OR vec_id <> only").select("qb", "item", "q", "vec_id", "score"), f"{folder}-first")
    # A range of scores for each different score of a query's positives.
    bands = first.where("score >= 0").select("qb", "item", "score").distinct()
    bands = bands.groupBy("qb").agg(F.sort_array(F.collect_list(F.struct("item", F.col("score").alias("positive_score")))).alias("bands"))
    bands = common.save(blocks.select("qb", "v", "labels").join(bands, "qb"), f"{folder}-bands")
    share = lambda part, up: F.transform("bands", lambda b: hundredths(b["positive_score"], part, up))
    ranges = bands.select("qb", "v", "labels", F.transform("bands", lambda b: b["item"]).alias("of"), share(lower, 99).alias("lowest"), share(upper, 0).alias("highest"))
    second = search(index, ranges, negatives, False, f"{folder}-negatives")
    of = bands.select("qb", F.posexplode("bands").alias("item", "b")).select("qb", "item", F.col("b.item").alias("query"), "b.positive_score")
    second = second.join(of, ["qb", "item"]).groupBy("qb", "query", "positive_score").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")))).alias("negatives"))
    joined = first.join(second, (first["qb"] == second["qb"]) & (first["item"] == second["query"]) & (first["score"] == second["positive_score"]), "left")
    entry = F.struct((-F.col("score")).alias("order"), F.col("vec_id").alias("positive_id"), "score", "negatives")
    lists = joined.groupBy("q").agg(F.sort_array(F.collect_list(entry)).alias("entries"))  # positives + 1 at most
    mine_of = asking.select("q", F.col("vec_id").alias("anchor_id")).join(lists, "q")
    own = F.slice(F.filter("entries", lambda e: e["positive_id"] != F.col("anchor_id")), 1, positives)
    out = mine_of.select("anchor_id", F.explode(own).alias("e")).select("anchor_id", "e.positive_id", F.col("e.score").alias("positive_score"), F.explode("e.negatives").alias("x"))
    return out.select("anchor_id", "positive_id", F.col("x.rank").alias("rank"), "x.negative_id", "positive_score", "x.negative_score")


#: The same by DuckDB, all anchors against all rows; for the labels and anchors of the query.
SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), p AS (
  SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5
)
SELECT p.a AS anchor_id, p.b AS positive_id, (row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b))::INTEGER AS rank,
  n.b AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3
"""
