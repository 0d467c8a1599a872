import random

import pytest
from pyspark.sql import functions as F

from codeatlas.operators import postings, ranked, search


def test_equals_a_scan_with_ties_and_reads_few_chunks(spark, tmp_path, monkeypatch):
    """Many rows of equal score, a term in every row, rare ones, and a filter on keys."""
    monkeypatch.setattr(ranked, "CHUNK", 16)
    r = random.Random(9)
    rows = [(i, " ".join(["all"] * r.choice((1, 1, 1, 2, 3, r.randrange(1, 30))) + [r.choice("abc") for _ in range(r.choice((1, 1, 5, r.randrange(40))))] + (["rare"] if i % 211 == 0 else []))) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, t string").repartition(4)
    postings.write(postings.occurrences(df, "id", ["t"]), str(tmp_path / "t"))
    found, lens = postings.read(spark, str(tmp_path / "t"), "long"), postings.lengths(df, "id", ["t"]).persist()
    directory = ranked.chunks(found, lens).persist()
    n, total = lens.agg(F.count("*"), F.sum("len")).first()
    seen = {}
    for q, where in (("all", None), ("a", None), ("rare", None), ("none", None), ("all", F.col("key") % 7 == 3)):
        scan = search.search_phrase(df, ["t"], q, "id", 12, None if where is None else F.col("id") % 7 == 3)
        got, seen[q] = ranked.search(found, lens, directory, q, 12, n, total, where=where)
        assert [tuple(x) for x in got.collect()] == [(x["id"], x["score"]) for x in scan.collect()], q
    got, seen["all"] = ranked.search(found, lens, directory, "all", 12, n, total)
    assert seen["all"]["chunks"] >= 3000 / 16 and seen["all"]["read"] < seen["all"]["chunks"] / 4
    assert directory.where("term = 'all'").agg(F.sum("keys")).first()[0] == 3000


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "x"), (2, "x")]])
def test_small_tables(spark, rows):
    df = spark.createDataFrame(rows, "id long, t string")
    found, lens = postings.occurrences(df, "id", ["t"]), postings.lengths(df, "id", ["t"])
    got, _ = ranked.search(found, lens, ranked.chunks(found, lens), "x", 5, max(1, len(rows)), 3)
    assert [r["key"] for r in got.collect()] == [i for i, t in rows if t]
