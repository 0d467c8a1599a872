import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeatlas.llm import hard_negatives
from codeatlas.operators import blocks, clusters, search


def test_sample_is_the_lowest_hashes_and_reads_few_rows_to_the_driver(spark):
    df = spark.range(20_000).repartition(16)
    want = sorted(r[0] for r in df.select(F.xxhash64("id")).collect())[:300]
    got = blocks.sample(df, F.xxhash64("id"), 300, 20_000)
    assert sorted(r[0] for r in spark.createDataFrame(got.to_pandas()).select(F.xxhash64("id")).collect()) == want
    same = spark.range(5000).selectExpr("id % 3 AS k")
    assert len(blocks.sample(same, F.xxhash64("k"), 900, 5000)) == 900
    assert len(blocks.sample(same, F.xxhash64("k"), 9000, 5000)) == 5000


@pytest.mark.parametrize("counts", [[], [5], [3, 3, 3, 3], [100, 1, 1, 50, 9, 2], [10, 10, 10]])
def test_parts_are_bounded_and_cells_of_one_part_are_neighbours(counts):
    first, splits = blocks.parts(counts, 10)
    held = {}
    for n, f, s in zip(counts, first, splits):
        for part in range(f, f + s):
            held[part] = held.get(part, 0) + -(-n // s)
    assert all(n <= 10 for n in held.values()) and (np.diff(first) >= 0).all()


def test_query_blocks_are_not_copied_for_each_cell(spark, monkeypatch):
    """Before, a row with a block's vectors was made for each cell that it visits, and these rows were broadcast."""
    sent, meet = [], blocks.meet

    def spy(asked, *rest):
        sent.append(asked.selectExpr("count(*)", "sum(size(cells))", "count(DISTINCT qb)").first())
        return meet(asked, *rest)

    monkeypatch.setattr(blocks, "meet", spy)
    g = np.random.default_rng(5)
    rows = [(i, g.standard_normal(6).tolist(), int(g.integers(3))) for i in range(3000)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert hard_negatives.mine(table, pivots=8, cells=8, block=32).count() > 100
    assert sent and all(n == asked < visited / 5 for n, visited, asked in sent)


def test_many_queries_meet_blocks_not_rows(spark, monkeypatch):
    """Copies, ties, odd rows and queries give what a scan gives; no plan pairs rows one by one."""
    monkeypatch.setattr(clusters, "ROWS_AT_ONCE", 64)
    monkeypatch.setattr(clusters, "MOST_HELD", 500)
    plans, best = [], blocks.meet
    monkeypatch.setattr(blocks, "meet", lambda *a: plans.append(1) or best(*a))
    g = np.random.default_rng(2)
    rows = [(i, (g.integers(-3, 4, 3) / 4).tolist()) for i in range(600)] + [(600 + i, [0.25, 0.5, 0.5]) for i in range(300)] + [(900 + i, g.standard_normal(3).tolist()) for i in range(600)]
    odd = [(2000, [math.nan, 0.0, 0.0]), (2001, [1.0, math.inf, 0.0])]
    df = spark.createDataFrame(rows + odd, "id long, v array<double>").repartition(5)
    held = clusters.centres(df, "v")
    placed = clusters.assigned(df, "v", held).persist()
    ask = df.where("id % 50 = 0 OR id = 2001").selectExpr("id AS query_id", "v AS vector")
    got = {}
    for r in clusters.nearest_all(placed, held, ask, "id", "v", 7).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], repr(r["distance"])))
    for i, v in rows[::300] + odd:
        want = [(k + 1, r["id"], repr(r["distance"])) for k, r in enumerate(search.nearest(df, v, "id", "v", 7).collect())]
        assert sorted(got[i]) == want, i
    assert len(got) == 32 and len(plans) == 2
    placed.unpersist()


def test_parts_that_no_query_visits(spark, monkeypatch):
    monkeypatch.setattr(blocks, "rows_of_part", lambda *_: 50)
    g = np.random.default_rng(3)
    rows = [(i, (g.standard_normal(2) + 50 * (i % 9)).tolist()) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    held = clusters.centres(df, "v")
    found = clusters.nearest_all(clusters.assigned(df, "v", held), held, df.where("id = 9").selectExpr("id AS query_id", "v AS vector"), "id", "v", 3).collect()
    want = [(r["id"], r["distance"]) for r in search.nearest(df, rows[9][1], "id", "v", 3).collect()]
    assert [(r["id"], r["distance"]) for r in sorted(found, key=lambda r: r["rank"])] == want
