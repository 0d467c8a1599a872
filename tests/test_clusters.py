import math

import numpy as np
import pytest

from codeatlas.operators import clusters, search


def points(n=800, d=6, seed=1):
    g = np.random.default_rng(seed)
    middles = g.standard_normal((12, d)) * 4
    return [(i, (middles[g.integers(12)] + 0.2 * g.standard_normal(d)).tolist()) for i in range(n)]


def test_equals_a_scan_and_reads_few_clusters(spark):
    rows = points()
    df = spark.createDataFrame(rows, "id long, v array<double>")
    held = clusters.centres(df, "v")
    placed = clusters.assigned(df, "v", held).persist()
    read = []
    for i in range(0, 800, 160):
        found, used = clusters.nearest(placed, held, rows[i][1], "id", "v", 7)
        assert [tuple(r) for r in found.select("id", "distance").collect()] == [tuple(r) for r in search.nearest(df, rows[i][1], "id", "v", 7).select("id", "distance").collect()]
        read.append(len(used))
    assert len(held) > 8 and np.mean(read) < len(held) / 3
    every = clusters.nearest_all(placed, held, df.where("id % 50 = 0").selectExpr("id AS query_id", "v AS vector"), "id", "v", 7).collect()
    by = {}
    for r in every:
        by.setdefault(r["query_id"], []).append((r["rank"], r["distance"], r["id"]))
    x = np.array([v for _, v in rows])
    for q, got in by.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        want = sorted((round(float(t), 6), i) for i, t in enumerate(d))[:7]
        assert [(t, i) for _, t, i in sorted(got)] == want
    assert len(by) == 16 and np.mean([r["read"] for r in every]) < len(held) / 3
    placed.unpersist()


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(k, [0.0, 0.0]) for k in range(9)], [(1, None), (2, [math.nan, 0.0]), (3, [1.0]), (4, [1.0, 1.0])]])
def test_few_equal_and_odd_vectors(spark, rows):
    df = spark.createDataFrame(rows, "id long, v array<double>")
    held = clusters.centres(df, "v")
    found, _ = clusters.nearest(clusters.assigned(df, "v", held), held, [1.0, 1.0], "id", "v", 3)
    assert repr(found.select("id", "distance").collect()) == repr(search.nearest(df, [1.0, 1.0], "id", "v", 3).select("id", "distance").collect())
