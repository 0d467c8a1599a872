import math

import numpy as np
import pytest

from codeatlas.llm import registry, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(vectors, k=4):
    """(n, sums, mean, values, vectors, trace) by a full eigendecomposition."""
    x = np.unique(np.floor(256 * np.array(vectors, float)), axis=0)
    n, mean = len(x), x.mean(axis=0)
    v = (x - mean).T @ (x - mean) / n
    values, q = np.linalg.eigh(v)
    return n, x.sum(axis=0), mean, values[::-1][:k], q[:, ::-1][:, :k], np.trace(v)


def matches(rows, vectors, k=4):
    n, sums, mean, values, q, trace = brute([v for _, v in vectors], k)
    by = {}
    for r in rows:
        by.setdefault(r["component"], {}).setdefault(r["vec_id"], []).append(r)
    assert sorted(by) == list(range(1, k + 1))
    for c, held in by.items():
        assert sum(map(len, held.values())) == len(vectors)
        want = {}
        for i, v in vectors:
            x = np.floor(256 * np.array(v, float))
            want[i] = float((x - mean) @ q[:, c - 1] / math.sqrt(values[c - 1])), int(((n * x - sums) ** 2).sum())
        sign = 1 if sum(held[i][0]["whitened"] * w for i, (w, _) in want.items()) > 0 else -1
        for i, (w, deviation) in want.items():
            for r in held[i]:
                assert abs(sign * r["whitened"] - w) < 1e-8
                assert (r["n"], r["deviation"]) == (n, deviation)
                assert abs(r["explained"] - values[c - 1] / trace) < 1e-9
                assert r["identity_error"] < 1e-9


def test_query_equals_eigendecomposition(spark):
    sf = "/root/testdata/sf0.001"
    vectors = [(r["vec_id"], r["embedding"]) for r in registry.table(spark, sf, "embeddings").collect()]
    matches(registry.op13_whitening(spark, sf).collect(), vectors)


@pytest.mark.parametrize("most_columns", [256, 24])
def test_wide_vectors_and_restarts(spark, most_columns):
    """Several passes, and a basis that has to shrink."""
    g = np.random.default_rng(5)
    data = g.standard_normal((300, 60)) * np.concatenate([[9, 7, 5, 4], np.linspace(2, 0.5, 56)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    rows = whitening.integers(df)
    w = whitening.fit(rows, 4, block=8, most_columns=most_columns)
    assert w.passes > 1 and w.residuals.max() < 1e-11
    values = brute(data)[3]
    assert np.allclose(w.values, values, rtol=1e-12)
    matches(whitening.apply(rows, w).collect(), [(i, v.tolist()) for i, v in enumerate(data)])


def test_rows_that_take_no_part_copies_and_clashing_columns(spark):
    g = np.random.default_rng(2)
    good = [(i, g.standard_normal(6).tolist(), 1) for i in range(40)]
    copies = [(100 + i, good[0][1], 2) for i in range(25)]
    bad = [(200, None, 1), (201, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (202, [math.nan] * 6, 1), (203, [math.inf] * 6, 1), (204, [], 1), (205, [1.0], 1)]
    df = spark.createDataFrame(good + copies + bad, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS x", "2 AS n", "'a' AS component")
    rows = whitening.whiten(df).collect()
    matches(rows, [(i, v) for i, v, _ in good + copies])


def test_null_ids_are_carried(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (None, [0.0, 1.0]), (1, [0.5, 0.25])], "vec_id long, embedding array<float>")
    rows = whitening.whiten(df).collect()
    assert sorted(str(r["vec_id"]) for r in rows) == ["1", "1", "None", "None", "None", "None"]


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0], 0)], [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], [(1, None, 0)]])
def test_nothing_varies(spark, rows):
    out = whitening.whiten(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert out.collect() == []


def test_fewer_components_than_asked(spark):
    """Points on a line have one component."""
    rows = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0], 0) for i in range(5)], SCHEMA)).collect()
    assert {r["component"] for r in rows} == {1} and len(rows) == 5


def test_large_entries(spark):
    """Deviations beyond a long are null, smaller ones exact."""
    rows = whitening.whiten(spark.createDataFrame([(1, [1e14, 0.0]), (2, [0.0, 3.0]), (3, [1e300, 5.0])], "vec_id long, embedding array<double>")).collect()
    assert all(r["deviation"] is None for r in rows if r["vec_id"] == 3)
    values = [[2**20 + 1, 7], [3, 5], [9, 2**21]]
    rows = whitening.whiten(spark.createDataFrame([(i, [v / 256 for v in x]) for i, x in enumerate(values)], "vec_id long, embedding array<double>")).collect()
    sums = [sum(c) for c in zip(*values)]
    for r in rows:
        assert r["deviation"] == sum((3 * v - s) ** 2 for v, s in zip(values[r["vec_id"]], sums))
