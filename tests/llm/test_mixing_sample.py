import random

import numpy as np

from codeatlas.llm import soft_mixing


def test_row_bound_takes_rows_by_hash_and_whole_texts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i:04d} " + "x" * (200_000 if i % 50 == 0 else 4)) for i in range(400)] * 2, "doc_id long, text string")
    labels = spark.createDataFrame([(i, "good") for i in range(400)], "doc_id long, domain string")
    monkeypatch.setattr(soft_mixing, "chosen", lambda counts, size: [f"w{i:04d}" for i in range(400)])
    seen = []
    monkeypatch.setattr(soft_mixing.Classifier, "train", lambda domains, pieces, rows: seen.extend(rows) or "fitted")
    assert soft_mixing.learn(docs, labels, most=200) == "fitted"
    ids = [r["doc_id"] for r in labels.selectExpr("doc_id", "xxhash64(doc_id) h").orderBy("h").collect()]
    assert sorted(int(at[0]) for _, at, _ in seen) == sorted(ids[:200])


def test_distributed_fit_is_the_local_one(spark):
    r = random.Random(4)
    word = lambda kind: f"{kind}{r.randrange(60)}"
    rows = [(i, " ".join(word("ab"[i % 2]) if r.random() < 0.4 else word("c") for _ in range(r.randrange(1, 60)))) for i in range(300)] + [(900, None), (901, "")]
    labels = [(i, "one" if i % 2 else "two") for i in range(300)] + [(900, "one"), (901, "two"), (5000, "one")]
    got = soft_mixing.learn(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, domain string"))
    want = soft_mixing.Classifier.fit([("one" if i % 2 else "two", t) for i, t in sorted(rows)])
    assert got.domains == want.domains and list(got.at) == list(want.at) and len(got.at) > 20
    assert np.allclose(got.weights, want.weights, atol=1e-3)


def test_rates_are_the_least_squares_solution(spark):
    """Brute force: the same projected steps over all documents at once, and the targets they are to meet."""
    r = random.Random(6)
    docs = spark.createDataFrame([(i, " ".join(r.choice(("a1", "b1", "c1")) for _ in range(r.randrange(0, 40)))) for i in range(80)] * 2 + [(None, "a1 b1")], "doc_id long, text string")
    c = soft_mixing.Classifier.fit([("a", "a1 a1 c1"), ("b", "b1 c1 b1"), ("a", "a1"), ("b", "b1")] * 20)
    rated = soft_mixing.rates(docs, c, {"a": 0.3, "b": 0.7}, "a", steps=40).collect()
    t, p = np.array([x["tokens"] for x in rated], float), np.array([x["p"] for x in rated])
    m = p * t[:, None]
    have = m.sum(axis=0)
    want = np.array([0.3, 0.7]) * have[0] / 0.3
    rate = np.ones(len(t))
    invert = np.linalg.pinv(m.T @ p / have.sum() + 1e-9 * np.eye(2))
    for _ in range(40):
        now = m.T @ rate
        if np.abs(now - want).max() <= 1e-4 * want.max():
            break
        rate = np.maximum(0, rate - p @ (invert @ ((now - want) / have.sum())))
    assert np.allclose([x["rate"] for x in rated], rate, atol=1e-6) and np.abs(m.T @ rate - want).max() < 0.01 * want.max()
    held = soft_mixing.rates(docs, c, {"a": 1.0}, "nowhere")
    assert held.count() == 161


def test_query_has_one_schema(spark, tmp_path):
    from codeatlas.llm import registry

    for name, labels in (("some", [(i, i % 2, 0) for i in range(40)]), ("none", [])):
        at = tmp_path / name
        spark.createDataFrame([(i, "good words here" if i % 2 else "| | |", "x") for i in range(40)], "doc_id long, text string, rate string").write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    a, b = (registry.op5_soft_mixing(spark, str(tmp_path / n)) for n in ("some", "none"))
    assert a.dtypes == b.dtypes and {r["rate"] for r in b.collect()} == {1.0} and {r["tokens"] for r in b.collect()} == {3}
