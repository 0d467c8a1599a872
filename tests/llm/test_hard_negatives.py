import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeatlas import scratch
from codeatlas.llm import hard_negatives, registry
from oracle import compare

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, every=50, positives=5, negatives=3):
    """rows: different (vec_id, vector, label) that take part."""
    rows = list(dict.fromkeys((i, tuple(math.floor(256 * c) for c in v), y) for i, v, y in rows))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a in rows:
        if a[0] % every:
            continue
        scored = sorted(((-dot(a[1], b[1]), b[0], b[2]) for b in rows if b[0] != a[0]))
        for s, p, _ in [x for x in scored if x[2] == a[2]][:positives]:
            held = [x for x in scored if x[2] != a[2] and 50 * -s <= 100 * -x[0] <= 95 * -s][:negatives]
            out += [(a[0], p, k + 1, x[1], -s, -x[0]) for k, x in enumerate(held)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def points(n, d=8, labels=4, seed=3):
    g = np.random.default_rng(seed)
    centres = g.standard_normal((6, d))
    return [(i, (centres[g.integers(6)] + 0.3 * g.standard_normal(d)).tolist(), int(g.integers(labels))) for i in range(n)]


def test_query_equals_sql(spark):
    assert compare(spark, "op11_hard_negatives", registry.op11_hard_negatives, registry.oracle_sql()["op11_hard_negatives"], "/root/testdata/sf0.001") > 50


def test_many_cells_and_rounds(spark, monkeypatch):
    """Small blocks and rounds: several pivots, cells and rounds, some cells never visited."""
    monkeypatch.setattr(hard_negatives, "AT_LEAST", 40)
    rows = points(1500, d=3)
    table = spark.createDataFrame(rows, SCHEMA)
    assert got(hard_negatives.mine(table, pivots=12, cells=8, block=16)) == brute(rows)
    folder = scratch.folder(spark)
    packed, width = hard_negatives.prepare(table, F.col("label"))
    index = hard_negatives.build(packed, width, folder, pivots=12, cells=8, block=16)
    assert len(index.cells) > 60 and index.count.sum() == 1500
    q = packed.where("vec_id % 50 = 0").select(F.col("id_of").alias("q"), "label", "v")
    blocks = hard_negatives.query_blocks(q, index, 4)
    whole = blocks.selectExpr("qb", "v", "labels", "sequence(0, size(qs) - 1) AS of", f"transform(qs, x -> -{2**62}L) AS lowest", f"transform(qs, x -> {2**62}L) AS highest")
    found = hard_negatives.search(index, whole, 3, True, f"{folder}-s")
    assert found.count() == 3 * 30
    last = spark.read.parquet(f"{folder}-s-2-state").selectExpr("size(seen) AS n").collect()
    assert np.mean([r["n"] for r in last]) < 0.6 * len(index.cells)


def test_copies_ties_and_one_hot_vector(spark):
    """A third of all rows are one vector under several labels; few different vectors, so that scores are equal everywhere."""
    g = np.random.default_rng(4)
    rows = [(i, [0.5, 0.25, -0.5], i % 3) for i in range(0, 900, 3)] + [(i, (g.integers(-2, 3, 3) / 4).tolist(), int(g.integers(3))) for i in range(901, 1500)]
    table = spark.createDataFrame(rows + rows[:50], SCHEMA).repartition(5)
    assert got(hard_negatives.mine(table, pivots=8, cells=4, block=16)) == brute(rows)


def test_rows_that_take_no_part(spark):
    good = points(120, d=4)
    bad = [(None, [1.0] * 4, 1), (1000, None, 1), (1050, [1.0, None, 1.0, 1.0], 1), (1100, [math.nan] * 4, 1), (1150, [math.inf] * 4, 1), (1200, [1.0] * 4, None), (1250, [], 1), (1300, [1.0] * 5, 1), (1350, [1e18] * 4, 1)]
    table = spark.createDataFrame(good + bad, SCHEMA).selectExpr("*", "1 AS x", "2 AS v", "3 AS q", "4 AS qb", "5 AS cell")
    assert got(hard_negatives.mine(table)) == brute(good)


def test_large_entries_are_exact(spark):
    """Scores beyond what doubles hold exactly."""
    g = np.random.default_rng(8)
    rows = [(i, [float(x) for x in g.integers(-(2**20), 2**20, 3)], int(g.integers(2))) for i in range(150)]
    rows += [(200 + i, [v + 1 / 256 for v in rows[i][1]], rows[i][2]) for i in range(60)]
    assert got(hard_negatives.mine(spark.createDataFrame(rows, SCHEMA), pivots=3, cells=2, block=32)) == brute(rows)


def test_same_id_for_different_rows(spark):
    """Each is an anchor; another vector of the same id is another row."""
    rows = [(0, [1.0, 0.0], 0), (0, [0.0, 1.0], 0), (1, [0.7, 0.7], 0), (2, [0.6, 0.1], 1), (3, [0.1, 0.6], 1)]
    out = got(hard_negatives.mine(spark.createDataFrame(rows, SCHEMA)))
    assert {r[:2] for r in out} == {(0, 1)} and len(out) > 1


@pytest.mark.parametrize("rows", [[], [(0, [1.0, 2.0], 1)], [(0, None, 1)], [(0, [0.0, 0.0], 1), (1, [0.0, 0.0], 1), (2, [1.0, 0.0], 2)], [(1, [1.0], 1), (2, [1.0], 2)]])
def test_small_tables(spark, rows):
    out = hard_negatives.mine(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert got(out) == brute([r for r in rows if r[1] is not None])
