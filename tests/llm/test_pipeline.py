import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codeatlas.llm import decontaminate, quality_rules, registry
from test_ngram_join import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("stages")
    docs, out = registry.table(spark, SF, "documents"), []
    for name, f in corpus_pipeline.STAGES:
        before = docs
        f(spark, docs, SF).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        out.append((before, docs))
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages_keep_columns(stages):
    for before, after in stages[:-1]:
        assert after.columns == before.columns


def test_quality(spark, stages):
    docs, kept = stages[0]
    judged = quality_rules.judge(docs, quality_rules.fit(docs, registry.table(spark, SF, "labels")))
    assert ids(kept) == sorted(r["doc_id"] for r in judged.collect() if r["kept"]) and kept.count() < docs.count()


def test_near_copies(stages):
    docs, kept = stages[1]
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], 5, 4, 5)
    assert ids(kept) == sorted({c for _, _, c in want})


def test_decontamination(spark, stages):
    docs, kept = stages[2]
    bench = [set(decontaminate.tokens_of(r["text"])) for r in registry.table(spark, SF, "benchmark").collect()]
    gone = set(ids(docs)) - set(ids(kept))
    # Whole passages are planted: their documents have nearly all of an item's words.
    words = {r["doc_id"]: set(decontaminate.tokens_of(r["text"])) for r in docs.collect()}
    near = {d for d, w in words.items() if any(len(b & w) >= 0.95 * len(b) for b in bench)}
    assert gone == near


def test_mixing_copies(stages):
    docs, kept = stages[3]
    assert set(ids(kept)) <= set(ids(docs)) and kept.count() > 0.7 * docs.count()


def odd_documents(spark):
    """Null ids, repeated rows, null, empty and long texts, and columns that clash with the stages' own."""
    clash = "n_words, words, carried, row, component_id, node, n, item_id, uid, domain, rate, copies, tie, copy, start, n_tokens".split(", ")
    item = registry.table(spark, SF, "benchmark").first()["text"]
    one = " ".join(f"a{i}" for i in range(60))
    texts = [(1, one), (1, one), (None, one), (2, one + " end"), (None, None), (3, None), (4, ""), (5, " \n"), (6, item), (None, item), (7, "Long words, all different. " + " ".join(f"w{i}" for i in range(40_000))), (7, "Another text of the same id, " + " ".join(f"v{i}" for i in range(50)))]
    return spark.createDataFrame([(d, t, "en", *[str(i)] * len(clash)) for i, (d, t) in enumerate(texts)], "doc_id long, text string, lang string, " + ", ".join(f"{c} string" for c in clash))


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_odd_documents(spark, empty, tmp_path):
    docs = odd_documents(spark)
    docs = docs.limit(0) if empty else docs
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, docs, SF)
        assert out.dtypes == docs.dtypes, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    out = corpus_pipeline.tokens(spark, docs, SF)
    assert out.count() == docs.count()
    if not empty:
        left = {(r["doc_id"], (r["text"] or "")[:12]) for r in docs.collect()}
        assert left == {(1, "a0 a1 a2 a3 "), (7, "Long words, "), (7, "Another text")}


def test_empty_side_tables(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        df = registry.table(spark, SF, t)
        (df if t == "documents" else df.limit(0)).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 100


def test_mixing_is_brute_force(spark, stages):
    """Each row as often as the rate of its id and text says, by the same classifier."""
    from collections import Counter

    from codeatlas.llm import soft_mixing

    docs, kept = stages[3]
    c = soft_mixing.learn(docs, soft_mixing.domain_table(registry.table(spark, SF, "labels")))
    rated = soft_mixing.rates(docs, c, registry.TARGETS, registry.ANCHOR, only_lower=True).collect()
    u = {r["doc_id"]: r["u"] for r in docs.selectExpr("doc_id", "pmod(xxhash64('mix', doc_id, xxhash64(text)), 1073741824) / 1073741824D AS u").collect()}
    want = Counter({r["doc_id"]: int(np.floor(r["rate"] + u[r["doc_id"]])) for r in rated})
    assert Counter(r["doc_id"] for r in kept.collect()) == +want


def test_tokens(stages):
    from tokenizers import Tokenizer

    docs, out = stages[4]
    t, want, at = Tokenizer.from_file(registry.tokenizer_path()), [], 0
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        x = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((r["doc_id"], at, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    assert sorted(map(tuple, out.collect())) == want


def test_mixing_without_labels(spark):
    docs = registry.table(spark, SF, "documents").limit(5).withColumn("extra", F.lit(1))
    from codeatlas.llm import soft_mixing

    c = soft_mixing.Classifier.fit([("good", "a b"), ("low", "| |")])
    assert soft_mixing.mix(docs, soft_mixing.rates(docs, c, {"good": 1.0}, "good")).columns == docs.columns


def test_chat_query_matches_sql(spark):
    from oracle import compare

    compare(spark, "op2_chat_format", registry.op2_chat_format, registry.oracle_sql()["op2_chat_format"], SF)


def test_rows_without_an_id_of_their_own(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(40)) for c in "abc")
    item = registry.table(spark, SF, "benchmark").first()["text"]
    rows = [(7, one), (None, one), (None, two), (None, two), (9, two + " end"), (5, three), (5, "other " + one[::-1]), (None, item), (8, item), (None, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(map(tuple, corpus_pipeline.near_copies(spark, docs, SF).collect()), key=str)
    assert kept == sorted([(7, one), (9, two + " end"), (5, three), (5, "other " + one[::-1]), (8, item), (None, None), (6, "")], key=str)
    clean = corpus_pipeline.decontamination(spark, docs, SF).collect()
    assert sorted(map(tuple, clean), key=str) == sorted([r for r in rows if r[1] != item], key=str)
