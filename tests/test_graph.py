import random
import re
import sqlite3

import pytest

from codeatlas.operators import graph


def like(pattern, text, con=sqlite3.connect(":memory:")):
    return bool(con.execute("SELECT ? LIKE ?", (text, pattern)).fetchone()[0])


def brute_callers(edges, start, depth):
    seen, frontier, out = {start}, {start}, []
    for level in range(1, depth + 1):
        met = [e for e in edges if any(e[1] == f or like(f"%.{f.rpartition('.')[2]}", e[1]) for f in frontier)]
        out += [(*e, level) for e in met]
        frontier = {e[0] for e in met} - seen
        seen |= frontier
    return sorted(out)


def brute_callees(edges, names, start, depth):
    seen, frontier, out = {start}, {start} & names, []
    for level in range(1, depth + 1):
        met = [e for e in edges if e[0] in frontier]
        out += [(*e, e[1] if e[1] in names else None, level) for e in met]
        frontier = {e[1] for e in met if e[1] in names} - seen
        seen |= frontier
    return sorted(out, key=str)


NAMES = ["a.get_user", "get_user", "b.getXuser", "m.Get_User", "c.get_user_id", "x.__init__", "y.abinitcd", "_", "z.%", "q.a%b", "d.aXXb", "e.a", "plain", "K.plain", "k.PLAIN", "w._p", "w.qp", "o.p\\q", "n.p\\q", "r.[x]", "u.a.b_c", "v.a-b"]


def test_traversal_is_brute_force(spark):
    r = random.Random(7)
    edges = [(r.choice(NAMES), r.choice(NAMES), r.randrange(9)) for _ in range(60)]
    df = spark.createDataFrame(edges, "caller string, callee string, line int")
    known = set(NAMES[::2])
    names = spark.createDataFrame([(n,) for n in NAMES[::2] * 2], "name string")
    for start in ("a.get_user", "x.__init__", "z.%", "q.a%b", "k.PLAIN", "o.p\\q", "nowhere", "_"):
        for depth in (1, 2, 3):
            assert sorted(map(tuple, graph.callers(df, start, depth).collect())) == brute_callers(edges, start, depth), (start, depth)
        assert sorted(map(tuple, graph.callees(df, names, start, 3).collect()), key=str) == brute_callees(edges, known, start, 3), start
    everything = spark.createDataFrame([(n,) for n in NAMES], "name string")
    got = sorted(map(tuple, graph.suffix_match(df, everything).collect()))
    assert got == sorted(e for e in edges if any(e[1] == f or like(f"%.{f.rpartition('.')[2]}", e[1]) for f in NAMES))


def test_no_nested_loop(spark):
    df = spark.createDataFrame([("a.get_user", "b.get_user", 1)], "caller string, callee string, line int")
    plan = graph.suffix_match(df, df.selectExpr("caller AS name"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("NestedLoop|Cartesian", plan)


def test_definitions_are_of_the_first_symbol(spark):
    rows = spark.createDataFrame([("a", "b"), ("a", "x")], "caller string, callee string")
    symbols = spark.createDataFrame([("b", "function", 9, "p.py"), ("b", "class", 4, "p.py"), ("b", "method", 1, "q.py"), ("c", "class", 1, "a.py")], "qualified_name string, kind string, line int, path string")
    got = {r["callee"]: tuple(r)[2:] for r in graph.with_definitions(rows, symbols, "callee", "def").collect()}
    assert got == {"b": ("class", 4, "p.py"), "x": (None, None, None)}


def walked(edges, start, depth):
    """A recursive depth-first walk: (caller, callee, line, depth) in its order."""
    seen, out, of = set(), [], {}
    for e in sorted(edges, key=lambda e: (e[2], e[1])):
        of.setdefault(e[0], []).append(e)

    def go(node, level):
        if level >= depth or node in seen:
            return
        seen.add(node)
        if node not in of:
            return
        for e in of[node]:
            out.append((*e, level + 1))
            if e[1] not in seen:
                go(e[1], level + 1)

    go(start, 0)
    return out


CHAIN = [("a", "b", 1), ("b", "c", 1), ("c", "d", 1), ("d", "e", 1), ("a", "d", 2), ("a", "c", 3)]


@pytest.mark.parametrize("depth", [1, 2, 3, 5])
@pytest.mark.parametrize("edges", [
    [("a", "b", 1), ("a", "c", 2), ("b", "d", 1), ("c", "e", 1)],
    [("a", "b", 2), ("a", "c", 1), ("b", "d", 1), ("c", "d", 1), ("d", "e", 1), ("e", "f", 1)],
    [("a", "b", 1), ("b", "a", 1), ("b", "b", 2), ("a", "a", 2), ("b", "c", 3), ("c", "a", 1)], CHAIN,
])
def test_depth_first_walk(spark, edges, depth):
    """Trees, diamonds, cycles, and a node that a deep first visit keeps from a shorter way."""
    df = spark.createDataFrame(edges, "caller string, callee string, line int")
    got = graph.callees_depth_first(df, df.selectExpr("caller AS name"), "a", depth).orderBy("place").collect()
    assert [(r["caller"], r["callee"], r["line"], r["depth"]) for r in got] == walked(edges, "a", depth)


def test_depth_first_walk_of_a_dense_graph(spark):
    import random

    r = random.Random(1)
    edges = [(f"n{r.randrange(60)}", f"n{r.randrange(70)}", k) for k in range(240)]
    df = spark.createDataFrame(edges, "caller string, callee string, line int")
    got = graph.callees_depth_first(df, df.selectExpr("caller AS name"), edges[0][0], 5).orderBy("place").collect()
    assert [(x["caller"], x["callee"], x["line"], x["depth"]) for x in got] == walked(edges, edges[0][0], 5)
    assert graph.callees_depth_first(df, df.selectExpr("caller AS name"), "nowhere", 3).count() == 0
