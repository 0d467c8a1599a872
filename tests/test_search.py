import sqlite3

from pyspark.sql import functions as F

from codeatlas.operators import postings, search


def test_bm25_is_fts5s(spark):
    rows = [(i, f"name{i % 7} x_y café", " ".join(["alpha beta", "beta", "foo foo foo", "the of the of"][: 1 + i % 4])) for i in range(60)]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(a, b)")
    con.executemany("INSERT INTO t(rowid, a, b) VALUES (?, ?, ?)", rows)
    df = spark.createDataFrame(rows, "id int, a string, b string")
    for q in ("alpha beta", "foo foo", "CAFE", "x y", "name3", "of the", "nothing here", "beta"):
        want = [(r, round(-s, 6)) for r, s in con.execute("SELECT rowid, rank FROM t WHERE t MATCH ? ORDER BY rank, rowid LIMIT 20", (f'"{q}"',))]
        got = [(r["id"], r["score"]) for r in search.search_phrase(df, ["a", "b"], q, "id").collect()]
        assert sorted(got) == sorted(want) or [s for _, s in got] == [s for _, s in want], q
    assert search.search_phrase(df, ["a", "b"], "!!!", "id").count() == 0


def test_snippet(spark):
    text = " ".join(f"w{i}" for i in range(100))
    df = spark.createDataFrame([(text,), ("W50, w51!",), ("other words",)], "t string")
    got = [r[0] for r in df.select(search.snippet(F.col("t"), "w50 w51", 10)).collect()]
    assert got == ["...w46 w47 w48 w49 >>>w50 w51<<< w52 w53 w54 w55...", ">>>W50, w51<<<...", "other words"]


def test_fusion_adds_duplicates_and_filters_after(spark):
    a = spark.createDataFrame([("x", "f", 0), ("y", "c", 1), ("x", "g", 2)], "q string, kind string, pos int")
    b = spark.createDataFrame([("z", "f", 0), ("y", "f", 1)], "q string, kind string, pos int")
    got = [tuple(r) for r in search.fuse([a, b], "q", 10).collect()]
    assert got == [("x", "g", round(1 / 60 + 1 / 62, 4)), ("y", "c", round(2 / 61, 4)), ("z", "f", round(1 / 60, 4))]
    assert [r["q"] for r in search.fuse([a, b], "q", 10, "f").collect()] == ["z"]


def test_nearest(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, [0.0, 1.0])], "id int, v array<float>")
    assert [(r["id"], r["distance"]) for r in search.nearest(df, [0, 0], "id", "v", 2).collect()] == [(1, 0.0), (3, 1.0)]


def test_postings_give_what_a_scan_gives(spark, tmp_path):
    rows = [(i, f"name{i % 7} x_y café", " ".join(["alpha beta", "beta", "foo foo foo", "the of the of the", ""][: 1 + i % 5])) for i in range(80)] + [(90, None, None)]
    df = spark.createDataFrame(rows, "id int, a string, b string")
    postings.write(postings.occurrences(df, "id", ["a", "b"]), str(tmp_path / "t"))
    found, lens = postings.read(spark, str(tmp_path / "t"), "int"), postings.lengths(df, "id", ["a", "b"])
    for q in ("alpha beta", "foo foo", "foo", "CAFE", "x y", "of the of", "the of the", "nothing here", "café alpha", "!!!", "zzz"):
        want = [(r["id"], r["score"]) for r in search.search_phrase(df, ["a", "b"], q, "id").collect()]
        assert [(r["key"], r["score"]) for r in postings.search(found, lens, q, 20).collect()] == want, q
