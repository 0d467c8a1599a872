"""Model tables derived from plain tables, so that operators run on any data: in DataFrames and, for comparison, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), F.sha2("text", 256).alias("sha256"), F.col("lang").alias("language"), F.octet_length("text").cast("long").alias("size_bytes"), F.col("text").alias("content"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of a document as a symbol."""
    return calling(spark, sf_dir).drop("callee")


def calling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols, and their lines' second words as `callee`. What is made of a text is made before the window, so that a reader of other columns shuffles no text."""
    text = F.col("text")
    lines = files(spark, sf_dir).select("doc_id", "path", "language", F.posexplode(F.split("content", "\n")).alias("pos", "text")).select(
        "doc_id", "path", "language", "pos", "text", F.octet_length(text).cast("long").alias("size"), F.split_part(text, F.lit(" "), F.lit(1)).alias("name"), F.split_part(text, F.lit(" "), F.lit(2)).alias("callee"), F.substring(text, 1, 40).alias("signature"),
    )
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    kind = F.element_at(F.array(*[F.lit(k) for k in ("function", "class", "method", "struct", "enum")]), (F.col("pos") % 5 + 1).cast("int"))
    return lines.select(
        "doc_id", "path", "language", (F.col("pos") + 1).cast("long").alias("line"), (F.col("pos") + 1).cast("long").alias("end_line"),
        F.concat_ws(".", F.col("doc_id").cast("string"), (F.col("pos") + 1).cast("string")).alias("qualified_name"), "name", kind.alias("kind"),
        "signature", text.alias("docstring"), F.coalesce(F.sum(F.col("size") + 1).over(before), F.lit(0)).alias("byte_offset"), F.col("size").alias("byte_length"), "callee",
    )


EDGE_RULES = [
    ("lineitem", "'lineitem.' || l_orderkey || '-' || l_linenumber", "'orders.' || l_orderkey", "l_linenumber", 1),
    ("lineitem", "'lineitem.' || l_orderkey || '-' || l_linenumber", "'part.' || l_partkey", "l_linenumber", 2),
    ("lineitem", "'lineitem.' || l_orderkey || '-' || l_linenumber", "'supplier.' || l_suppkey", "l_linenumber", 3),
    ("orders", "'orders.' || o_orderkey", "'customer.' || o_custkey", "1", 4),
    ("customer", "'customer.' || c_custkey", "'nation.' || c_nationkey", "1", 5),
    ("supplier", "'supplier.' || s_suppkey", "'nation.' || s_nationkey", "1", 6),
    ("nation", "'nation.' || n_nationkey", "'region.' || n_regionkey", "1", 7),
]
NAME_RULES = [(t, f"'{t}.' || {k}") for t, k in (("orders", "o_orderkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey"), ("nation", "n_nationkey"), ("region", "r_regionkey"))] + [("lineitem", "'lineitem.' || l_orderkey || '-' || l_linenumber")]


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign keys as calls: caller, callee, line, rule."""
    out, tables = None, {t: table(spark, sf_dir, t) for t in dict.fromkeys(r[0] for r in EDGE_RULES)}
    for t, caller, callee, line, rule in EDGE_RULES:
        part = tables[t].select(F.expr(caller).alias("caller"), F.expr(callee).alias("callee"), F.expr(line).cast("int").alias("line"), F.lit(rule).alias("rule"))
        out = part if out is None else out.unionByName(part)
    return out


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for t, name in NAME_RULES:
        part = table(spark, sf_dir, t).select(F.expr(name).alias("name"))
        out = part if out is None else out.unionByName(part)
    return out


DEFINITION_RULES = [("orders", "o_orderkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey"), ("nation", "n_nationkey"), ("region", "r_regionkey")]


def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qualified_name, kind, line, path of what edges between tables name."""
    out = None
    for t, key in DEFINITION_RULES:
        part = table(spark, sf_dir, t).select(F.concat(F.lit(f"{t}."), key).alias("qualified_name"), F.lit(t).alias("kind"), (F.col(key) % 97).cast("long").alias("line"), F.lit(f"{t}.parquet").alias("path"))
        out = part if out is None else out.unionByName(part)
    return out


#: A Python file for each document: `X` stands for the first line's words, which differ, and `#` for the doc_id.
SOURCE_LINES = ["# X", "@mark(#)", "def f#(a, b=1) -> int:", '    """Doc #."""', "    return g#.h(a)", "class C#(Base):", "    def m(self):", "        self.n()"]
SOURCE_WORDS = [b"plain", b"\xff\xfe\xc3", b"plain", "é日".encode()]


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, language, content: line ends are \\r\\n in every fourth file."""
    k = (F.col("doc_id") % 4).cast("int")
    end = F.when(k == 2, F.lit("\r\n")).otherwise(F.lit("\n"))
    rest = F.concat(*[x for line in SOURCE_LINES[1:] for x in (end, *[y for j, part in enumerate(line.split("#")) for y in ([F.col("doc_id").cast("string")] if j else []) + [F.lit(part)]])], end)
    first = F.element_at(F.array(*[F.unhex(F.lit(w.hex())) for w in SOURCE_WORDS]), k + 1)
    content = F.concat(F.lit("# ").cast("binary"), first, rest.cast("binary"))
    return table(spark, sf_dir, "documents").select(F.concat("doc_id", F.lit(".py")).alias("path"), F.lit("python").alias("language"), content.alias("content"))


def _sources_sql() -> str:
    """What is in `sources`, by arithmetic on the lengths of its lines."""
    text = lambda line: "'" + line.replace("'", "''").replace("#", "' || doc_id || '") + "'"
    upto = lambda n: f"2 + w + nl + {sum(len(x.replace('#', '')) for x in SOURCE_LINES[1:n])} + {sum(x.count('#') for x in SOURCE_LINES[1:n])} * n + {n - 1} * nl"
    body = lambda a, b: " || eol || ".join(text(x) for x in SOURCE_LINES[a:b])
    rows = [
        ("'f' || doc_id", "function", "'f' || doc_id || ' (a, b=1) -> int'", "'Doc ' || doc_id || '.'", "'[\"@mark(' || doc_id || ')\"]'", "''", 3, 5, upto(2), body(2, 5)),
        ("'C' || doc_id", "class", "'C' || doc_id || ' (Base)'", "''", "NULL", "''", 6, 8, upto(5), body(5, 8)),
        ("'C' || doc_id || '.m'", "function", "'m (self)'", "''", "NULL", "'C' || doc_id", 7, 8, f"{upto(6)} + 4", f"substring({body(6, 8)}, 5)"),
    ]
    s = f"SELECT doc_id, ([{', '.join(str(len(w)) for w in SOURCE_WORDS)}])[doc_id % 4 + 1] AS w, CASE WHEN doc_id % 4 = 2 THEN chr(13) || chr(10) ELSE chr(10) END AS eol, CASE WHEN doc_id % 4 = 2 THEN 2 ELSE 1 END AS nl, length(doc_id::VARCHAR) AS n FROM documents"
    one = lambda q, kind, sign, doc, marks, parent, a, b, at, src: f"SELECT doc_id || '.py' AS path, {q} AS qualified_name, '{kind}' AS kind, {sign} AS signature, {doc} AS docstring, {marks} AS decorators, {parent} AS parent_name, {a} AS line, {b} AS end_line, ({at})::BIGINT AS byte_offset, length({src})::BIGINT AS byte_length, sha256({src}) AS source_sha FROM ({s})"
    return " UNION ALL ".join(one(*r) for r in rows)


SOURCES_SQL = _sources_sql()


def sparse_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse graph with cycles over part keys, two edges from each."""
    parts = table(spark, sf_dir, "part")
    n = parts.count()
    k = F.col("p_partkey")
    each = parts.select(k.alias("k"), F.posexplode(F.array((k * 7 + 3) % n, (k * k + 1) % n)).alias("pos", "to"))
    return each.select(F.concat(F.lit("n"), "k").alias("caller"), F.concat(F.lit("n"), "to").alias("callee"), (F.col("pos") + 1).alias("line"))


def event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successive event types of each user: a small complete graph with self-loops and many repeats."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("caller"), F.lead("event_type").over(w).alias("callee"), F.lit(1).alias("line"))
    return e.where(F.col("callee").isNotNull())


SQL = {
    "v_files": "SELECT doc_id, source || '/' || lang || '/' || doc_id || '.txt' AS path, sha256(text) AS sha256, lang AS language, octet_length(encode(text))::BIGINT AS size_bytes, text AS content FROM documents",
    "v_lines": "SELECT doc_id, path, language, unnest(string_split(content, chr(10))) AS text, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM v_files",
    "v_symbols": "SELECT doc_id, path, language, line::BIGINT AS line, line::BIGINT AS end_line, doc_id || '.' || line AS qualified_name, split_part(text, ' ', 1) AS name, (['function', 'class', 'method', 'struct', 'enum'])[(line - 1) % 5 + 1] AS kind, substring(text, 1, 40) AS signature, text AS docstring, coalesce(sum(octet_length(encode(text)) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS byte_offset, octet_length(encode(text))::BIGINT AS byte_length FROM v_lines",
    "v_edges": " UNION ALL ".join(f"SELECT {a} AS caller, {b} AS callee, ({line})::INT AS line, {rule} AS rule FROM {t}" for t, a, b, line, rule in EDGE_RULES),
    "v_names": " UNION ALL ".join(f"SELECT {n} AS name FROM {t}" for t, n in NAME_RULES),
    "v_definitions": " UNION ALL ".join(f"SELECT '{t}.' || {k} AS qualified_name, '{t}' AS kind, ({k} % 97)::BIGINT AS line, '{t}.parquet' AS path FROM {t}" for t, k in DEFINITION_RULES),
    "v_sparse": "SELECT 'n' || k AS caller, 'n' || unnest([(k * 7 + 3) % n, (k * k + 1) % n]) AS callee, unnest([1, 2]) AS line FROM (SELECT p_partkey AS k, (SELECT count(*) FROM part) AS n FROM part)",
    "v_events": "SELECT * FROM (SELECT event_type AS caller, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS callee, 1 AS line FROM events) WHERE callee IS NOT NULL",
}


def with_views(*wanted: str) -> str:
    """A WITH clause of the views named, in an order that lets them use one another."""
    return "WITH " + ", ".join(f"{v} AS ({SQL[v]})" for v in SQL if v in wanted)
