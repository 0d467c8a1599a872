import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeatlas.api import Index
from codeatlas.operators import embedding


def bag(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").select("id", "text", embedding.buckets(F.col("text")).alias("words"))


def dense(rows, window=embedding.WINDOW):
    """Buckets and their mutual information, counted pair by pair."""
    names = sorted({b for r in rows for b in r or []})
    c = np.zeros((len(names),) * 2)
    for r in rows:
        at = [names.index(b) for b in r or []]
        for i, x in enumerate(at):
            for d, y in enumerate(at[i + 1 : i + 1 + window]):
                c[x, y] += window - d
                c[y, x] += window - d
    met = c.sum(axis=1) > 0
    c, names = c[met][:, met], np.array(names)[met]
    s = c.sum(axis=1) ** embedding.SMOOTH
    s /= s.sum()
    with np.errstate(divide="ignore"):
        return names, np.maximum(np.log(c / c.sum() / s[:, None] / s[None]), 0), c


def prose(n=300, words=60, seed=3):
    g = random.Random(seed)
    return [" ".join(f"{chr(97 + k // 26)}{chr(97 + k % 26)}x" for k in (min(words - 1, int(g.expovariate(0.08))) for _ in range(g.randint(0, 30)))) for _ in range(n)]


def test_words(spark):
    out = spark.createDataFrame([("parseURLNow2Day  snake_case été",), ("PARSE url now 2 day snake case ÉTÉ",), ("",), (" -- ",), (None,)], "t string").select(embedding.buckets(F.col("t"))).collect()
    assert out[0][0] == out[1][0] and len(out[0][0]) == 8 and out[2][0] == out[3][0] == [] and out[4][0] is None


def test_counts_and_vectors_equal_a_dense_decomposition(spark, monkeypatch):
    monkeypatch.setattr(embedding, "WORDS_AT_ONCE", 64)
    df = bag(spark, [*prose(), "", None, "alone", "twin twin"])
    rows = [r["words"] for r in df.collect()]
    names, m, c = dense(rows)
    counts = {(r["a"], r["b"]): r["n"] for r in embedding.context_counts(df, "words").collect()}
    want = {(int(names[i]), int(names[j])): int(c[i, j]) // (2 if i == j else 1) for i, j in zip(*np.nonzero(np.triu(c)))}
    assert counts == want
    model = embedding.fit(df, "words")
    assert model.vectors.shape[1] == embedding.DIMS and not set(model.buckets) - set(names)
    values, y = np.linalg.eigh(m)
    whole = (y * np.abs(values)) @ y.T  # the vectors' inner products where all directions are kept
    size = np.sqrt(np.diag(whole))
    held = np.isin(names, model.buckets)
    assert np.allclose(model.vectors @ model.vectors.T, (whole / size[:, None] / size[None])[held][:, held], atol=1e-4)
    few = embedding.fit(df, "words", dims=8, passes=40)
    best = values[np.argsort(-np.abs(values))][:8]
    assert few.vectors.shape[1] == 8 and np.allclose(np.abs(few.values), np.abs(best), rtol=1e-3)


def test_leading_directions_of_a_larger_matrix(spark, monkeypatch):
    monkeypatch.setattr(embedding, "EXTRA", 8)
    g = np.random.default_rng(5)
    q = np.linalg.qr(g.standard_normal((120, 120)))[0]
    values = np.concatenate([[50, -40, 30, 20], g.standard_normal(116)])
    m = (q * values) @ q.T
    names = np.arange(0, 360, 3)
    rows = spark.createDataFrame([(int(names[i]), int(names[j]), float(m[i, j])) for i in range(120) for j in range(120)], "a int, b int, w double").repartition(5)
    found, vectors = embedding.leading(rows, names, 4, 8)
    assert np.allclose(found, values[:4], rtol=1e-6)
    assert np.allclose(np.abs(np.sum(vectors * q[:, :4], axis=0)), 1, atol=1e-6)


def test_planted_synonyms_are_neighbours(spark):
    g = random.Random(1)
    topics = {t: [f"{t}{chr(97 + k)}q" for k in range(12)] for t in ("red", "sky", "oak", "sea", "fog", "ice")}
    texts = []
    for t, around in topics.items():
        for k in range(120):
            words = g.sample(around, 6)
            texts.append(" ".join(words[:3] + [f"{t}first" if k % 2 else f"{t}second"] + words[3:]))
    model = embedding.fit(bag(spark, texts), "words")
    asked = spark.createDataFrame([(w,) for t in topics for w in (f"{t}first", f"{t}second")], "w string").select("w", embedding.buckets(F.col("w")).alias("b")).collect()
    v = {r["w"]: model.vector(r["b"]) for r in asked}
    for t in topics:
        near = max((w for w in v if w != f"{t}first"), key=lambda w: float(v[w] @ v[f"{t}first"]))
        assert near == f"{t}second"
    assert all(abs(np.linalg.norm(x) - 1) < 1e-5 for x in v.values())


@pytest.mark.parametrize("texts", [[], [None], [""], ["one"], ["same same same"], ["one", "one", None, "--"]])
def test_few_words(spark, texts):
    df = bag(spark, texts)
    model = embedding.fit(df, "words")
    out = {r["id"]: r["embedding"] for r in embedding.embedded(df, F.col("words"), model).collect()}
    for i, t in enumerate(texts):
        assert (out[i] is None) == (t in (None, "", "--"))
        assert out[i] is None or len(out[i]) == embedding.DIMS and abs(np.linalg.norm(out[i]) - 1) < 1e-5
    again = embedding.read(model.table(spark))
    assert again.buckets.tolist() == model.buckets.tolist() and np.allclose(again.vectors, model.vectors)


def test_hybrid_search_without_a_function(spark, tmp_path):
    root = tmp_path / "repo"
    root.mkdir()
    verbs = {"fetch": "download remote page over network socket", "retrieve": "download remote page over network socket", "draw": "paint shape on screen canvas colour", "sum": "add numbers list total arithmetic"}
    for v, doc in verbs.items():
        for k, noun in enumerate(("alpha", "beta", "gamma")):
            (root / f"{v}{k}.py").write_text(f'def {v}_{noun}(x):\n    """{v} {doc}"""\n    return x\n')
    index = Index(spark, str(tmp_path / "home"))
    r = str(root)
    index.index_folder(r, embed=True)
    sizes = {len(x["embedding"]) for x in index.symbols(r).collect()}
    assert sizes == {embedding.DIMS}
    found = index.search_symbols(r, "fetch", limit=6).collect()
    assert {x["search_type"] for x in found} == {"hybrid"}
    # Half of the words' neighbours never hold the word.
    assert {x["qualified_name"].partition("_")[0] for x in found} == {"fetch", "retrieve"}
    before = {x["id"]: x["embedding"] for x in index.symbols(r).collect()}
    (root / "new.py").write_text('def zorkify(x):\n    """zorkify quux"""\n    return x\n')
    index.index_folder(r, embed=True)
    after = {x["id"]: x["embedding"] for x in index.symbols(r).collect()}
    assert {k: after[k] for k in before} == before and len(after) == len(before) + 1  # one model for old and new rows
    assert index.search_symbols(r, "quux zorkify").first()["qualified_name"] == "zorkify"
    index.invalidate_cache(r)
    assert index.index_folder(r, embed=True)["indexed"] == 13 and index.table(r, "model").count() > 0
    assert index.search_symbols(r, "zorkify").first()["search_type"] == "hybrid"
