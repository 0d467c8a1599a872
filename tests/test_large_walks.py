import pytest

from codeatlas import scratch
from codeatlas.operators import embedding, graph, postings, ranked


def brute(edges, names):
    tails = {n.rpartition(".")[2].lower() for n in names}
    return sorted(e for e in edges if e[1] in names or "." in e[1] and e[1].rpartition(".")[2].lower() in tails)


@pytest.mark.parametrize("sent", [0, 100])
def test_names_whose_segment_is_met_are_not_joined_again(spark, monkeypatch, sent):
    """One join of the edges, of as many partitions as they need; names without a dot still count."""
    monkeypatch.setattr(graph, "MOST_SENT", sent)
    edges = [(f"c{i}", f"{'abc'[i % 3]}.K{i % 17}" if i % 5 else f"k{i % 17}", i) for i in range(400)]
    df = spark.createDataFrame(edges, "caller string, callee string, line int")
    dotted = [f"x.k{i}" for i in range(0, 17, 4)]
    got = graph.suffix_match(df, spark.createDataFrame([(n,) for n in dotted], "name string"))
    assert sorted(map(tuple, got.collect())) == brute(edges, set(dotted))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    bare = [*dotted, "k3", "k5"]
    got = graph.suffix_match(df, spark.createDataFrame([(n,) for n in bare], "name string"))
    assert sorted(map(tuple, got.collect())) == brute(edges, set(bare))
    steps = [(f"n.{i}", f"n.{i // 2}", 1) for i in range(1, 200)]
    up = graph.callers(spark.createDataFrame(steps, "caller string, callee string, line int"), "n.5", 3)
    assert sorted((r["caller"], r["depth"]) for r in up.collect()) == sorted((f"n.{i}", k) for k, of in ((1, (10, 11)), (2, range(20, 24)), (3, range(40, 48))) for i in of)


def test_chunks_are_cut_from_a_stream(spark, monkeypatch):
    """A task holds few rows, whatever its partition."""
    monkeypatch.setattr(ranked, "CHUNK", 16)
    df = spark.createDataFrame([(i, "all " * (i % 4 + 1) + "abc"[i % 3]) for i in range(900)], "id long, t string").coalesce(1)
    found, lens = postings.occurrences(df, "id", ["t"]), postings.lengths(df, "id", ["t"])
    monkeypatch.setattr(ranked, "ROWS_AT_ONCE", 40)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "25")
    rows = ranked.chunks(found, lens).where("term = 'all'").orderBy("first").collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sum(r["keys"] for r in rows) == 900 and max(r["keys"] for r in rows) == 16 and len(rows) <= 900 // 16 + 5
    assert all(a["last"] < b["first"] for a, b in zip(rows, rows[1:])) and all(max(r["tfs"]) == 4 for r in rows)


def test_a_shuffle_has_as_many_partitions_as_rows_need(spark, tmp_path):
    assert scratch.partitions(spark, 0) == 4 and scratch.partitions(spark, 5_000_000) == 10
    df = spark.range(1000).selectExpr("id AS key", "0 AS part", "0 AS pos", "string(id) AS term")
    postings.write(df, str(tmp_path / "t"), 5_000_000)
    assert len(list((tmp_path / "t").glob("part-*"))) == 10


def test_joins_are_not_repeated_in_each_branch_of_a_union(spark, monkeypatch):
    """Before, a task that read all branches held the sorts of all of them."""
    monkeypatch.setattr(graph, "MOST_SENT", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    part = lambda a: spark.range(30).selectExpr(f"'{a}.' || id AS qualified_name", f"'{a}' AS kind", "id AS line", f"'{a}.py' AS path")
    symbols = part("a").unionByName(part("b")).unionByName(part("c"))
    rows = spark.range(9).selectExpr("'b.' || id * 4 AS caller")
    got = graph.with_definitions(rows, symbols, "caller", "caller")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Join ") == 2
    assert sorted(map(tuple, got.collect())) == sorted((f"b.{4 * i}", "b" if 4 * i < 30 else None, 4 * i if 4 * i < 30 else None, "b.py" if 4 * i < 30 else None) for i in range(9))


def test_few_whole_texts_are_held_while_contexts_are_counted(spark, monkeypatch):
    seen, save = [], scratch.save
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    monkeypatch.setattr(scratch, "save", lambda df, path: seen.append((path.rpartition("-")[2], spark.conf.get(size))) or save(df, path))
    before = spark.conf.get(size)
    words = spark.range(600).selectExpr("array(int(id % 5), int(id % 3), int(id % 7)) AS words")
    assert len(embedding.fit(words, "words").buckets) > 0
    assert dict(seen)["counts"] == "256" and dict(seen)["matrix"] == before == spark.conf.get(size)
