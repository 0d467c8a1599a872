"""The queries over plain tables, each with its SQL for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from .. import scratch
from ..functions import patterns, scalars
from ..operators import clusters, embedding, graph, lookup, postings, ranked, resolution, search, snapshot
from ..operators.segments import Segments
from ..sources import extract, files
from ..streaming import ingest
from . import views as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _bm25(source: str, columns: list[str], phrase: list[str]) -> str:
    """WITH steps t (with tf and len) and h (with rank)."""
    toks = lambda c: f"list_filter(regexp_split_to_array(strip_accents(lower(coalesce({c}, ''))), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    n, want = len(phrase), "[" + ", ".join(f"'{w}'" for w in phrase) + "]"
    tf = " + ".join(f"len(list_filter(range(1, len(k{i}) - {n} + 2), lambda p: k{i}[p:p + {n} - 1] = {want}))" for i in range(len(columns)))
    size = " + ".join(f"len(k{i})" for i in range(len(columns)))
    split = ", ".join(f"{toks(c)} AS k{i}" for i, c in enumerate(columns))
    return (
        f"k AS (SELECT *, {split} FROM {source}), t AS (SELECT *, {tf} AS tf, {size} AS len FROM k), "
        "s AS (SELECT count(*) AS n, sum(len)::DOUBLE / count(*) AS avg_len, count(*) FILTER (tf > 0) AS hits FROM t), "
        f"h AS (SELECT t.*, round(greatest(ln((n - hits + 0.5::DOUBLE) / (hits + 0.5::DOUBLE)), {K.LEAST_IDF}::DOUBLE) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len)), 6) AS score FROM t, s WHERE tf > 0)"
    )


PHRASE, WORDS = "of the", ["of", "the"]


@query(f"WITH {_bm25('documents', ['text'], WORDS)} SELECT doc_id, score FROM h ORDER BY score DESC, doc_id LIMIT 20")
def fts_phrase_bm25(spark, d):
    return search.search_phrase(V.table(spark, d, "documents").select("doc_id", "text"), ["text"], PHRASE, "doc_id").select("doc_id", "score")


@query(f"WITH v AS (SELECT doc_id, source, text FROM documents), {_bm25('v', ['source', 'text'], ['que', 'de'])} SELECT doc_id, score FROM h ORDER BY score DESC, doc_id LIMIT 50")
def fts_two_columns(spark, d):
    return search.search_phrase(V.table(spark, d, "documents").select("doc_id", "source", "text"), ["source", "text"], "Qué-DE", "doc_id", 50).select("doc_id", "score")


_T, _G = "[\\p{L}\\p{N}]+", "[^\\p{L}\\p{N}]+"
_SNIP = f"(?is)(?:^|[^\\p{{L}}\\p{{N}}])((?:{_T}{_G}){{0,19}})(of{_G}the)((?:{_G}{_T}){{0,19}})(?:$|[^\\p{{L}}\\p{{N}}])"
_GET = [f"regexp_extract(content, '{_SNIP}', {k})" for k in range(4)]


@query(f"""{V.with_views('v_files')}, {_bm25('v_files', ['path', 'content'], WORDS)}, top AS (SELECT * FROM h WHERE path GLOB 'src1*/en/*' ORDER BY score DESC, path LIMIT 20)
SELECT path, score, CASE WHEN starts_with(content, {_GET[1]} || {_GET[2]}) THEN '' ELSE '...' END || {_GET[1]} || '>>>' || {_GET[2]} || '<<<' || {_GET[3]} || CASE WHEN suffix(content, {_GET[2]} || {_GET[3]}) THEN '' ELSE '...' END AS snippet FROM top""")
def text_search_glob(spark, d):
    return search.search_text(V.files(spark, d), PHRASE, "src1*/en/*")


def _vector(spark, d):
    return V.table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0]


_KNN = "SELECT vec_id, round(list_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS distance FROM embeddings"


@query(f"{_KNN} ORDER BY distance, vec_id LIMIT 20")
def vector_knn_l2(spark, d):
    return search.nearest(V.table(spark, d, "embeddings"), _vector(spark, d), "vec_id", "embedding").select("vec_id", "distance")


def _rrf(kind: str = "") -> str:
    return f"""WITH {_bm25('documents', ['text'], WORDS)}, a AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS pos, 0 AS arm FROM (SELECT * FROM h ORDER BY score DESC, doc_id LIMIT 40)),
b AS (SELECT vec_id AS id, row_number() OVER (ORDER BY distance, vec_id) - 1 AS pos, 1 AS arm FROM ({_KNN} ORDER BY distance, vec_id LIMIT 40)),
f AS (SELECT id, sum(1.0::DOUBLE / (60 + pos)) AS raw, min(arm * 1000 + pos) AS first FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id)
SELECT id, 'k' || id % 3 AS kind, round(raw, 4) AS score FROM f {kind} ORDER BY raw DESC, first, id LIMIT 20"""


def _arms(spark, d):
    kind = lambda c: F.concat(F.lit("k"), (F.col(c) % 3).cast("string")).alias("kind")
    docs = search.search_phrase(V.table(spark, d, "documents").select("doc_id", "text"), ["text"], PHRASE, "doc_id", 40)
    near = search.nearest(V.table(spark, d, "embeddings"), _vector(spark, d), "vec_id", "embedding", 40)
    return [search.ranked(docs, F.desc("score"), "doc_id").select(F.col("doc_id").alias("id"), kind("doc_id"), "pos"), search.ranked(near, "distance", "vec_id").select(F.col("vec_id").alias("id"), kind("vec_id"), "pos")]


@query(_rrf())
def hybrid_rrf(spark, d):
    return search.fuse(_arms(spark, d), "id", 20)


@query(_rrf("WHERE id % 3 = 1"))
def hybrid_rrf_kind_filter(spark, d):
    return search.fuse(_arms(spark, d), "id", 20, "k1")


_FIRST = "(SELECT min(path) FROM v_files)"


@query(f"{V.with_views('v_files', 'v_lines', 'v_symbols')} SELECT name, qualified_name, kind, line, end_line, signature, substring(docstring, 1, 100) AS docstring FROM v_symbols WHERE path = {_FIRST}")
def file_outline(spark, d):
    return lookup.file_outline(V.symbols(spark, d), V.files(spark, d).agg(F.min("path")).first()[0])


@query(f"{V.with_views('v_files', 'v_lines', 'v_symbols')} SELECT qualified_name, kind, path AS file, line, signature FROM v_symbols WHERE kind = 'class' ORDER BY path, line, qualified_name LIMIT 200")
def repo_outline(spark, d):
    return lookup.repo_outline(V.symbols(spark, d), "class")


@query(f"{V.with_views('v_files', 'v_lines', 'v_symbols')} SELECT path, language, size_bytes, (SELECT count(*) FROM v_symbols s WHERE s.path = f.path) AS symbols FROM v_files f WHERE path ILIKE 'src1%'")
def file_tree(spark, d):
    return lookup.file_tree(V.files(spark, d), V.symbols(spark, d), "SRC1", 3)


@query(f"{V.with_views('v_files')} SELECT dir, count(*) AS files, sum(size_bytes)::BIGINT AS bytes FROM (SELECT size_bytes, unnest(['', string_split(path, '/')[1], string_split(path, '/')[1] || '/' || string_split(path, '/')[2]]) AS dir FROM v_files) GROUP BY dir")
def dir_rollup(spark, d):
    return lookup.directory_rollup(V.files(spark, d))


@query(f"""{V.with_views('v_files', 'v_lines', 'v_symbols', 'v_edges', 'v_names')}, e AS (SELECT caller, n.name AS callee_id FROM v_edges LEFT JOIN v_names n ON callee = n.name AND rule % 2 = 1)
SELECT 'files' AS metric, '' AS key, count(*) AS n FROM v_files UNION ALL SELECT 'symbols', '', count(*) FROM v_symbols UNION ALL SELECT 'call_edges', '', count(*) FROM e UNION ALL SELECT 'resolved_edges', '', count(callee_id) FROM e
UNION ALL SELECT 'language', language, count(*) FROM v_files WHERE language IS NOT NULL GROUP BY language UNION ALL SELECT 'kind', kind, count(*) FROM v_symbols GROUP BY kind""")
def repo_stats(spark, d):
    e = V.edges(spark, d).join(V.names(spark, d).withColumnRenamed("name", "callee_id"), (F.col("callee") == F.col("callee_id")) & (F.col("rule") % 2 == 1), "left")
    return lookup.repo_stats(V.files(spark, d), V.symbols(spark, d), e)


@query(f"{V.with_views('v_files', 'v_lines', 'v_symbols')} SELECT qualified_name, byte_offset, byte_length, sha256(docstring) AS source_sha, length(docstring) AS source_chars FROM v_symbols")
def symbol_source_slice(spark, d):
    return lookup.source(V.symbols(spark, d), V.files(spark, d)).select("qualified_name", "byte_offset", "byte_length", F.sha2("source", 256).alias("source_sha"), F.length("source").cast("long").alias("source_chars"))


_ASKED = ["3.2", "1.1", "nowhere", "5.1", "3.2", "2.9999"]


@query(f"{V.with_views('v_files', 'v_lines', 'v_symbols')}, asked AS (SELECT unnest({_ASKED!r}) AS asked, unnest(range(0, {len(_ASKED)})) AS pos) SELECT pos, asked, path, line, CASE WHEN path IS NULL THEN 'Symbol not found: ' || asked END AS error FROM asked LEFT JOIN v_symbols ON asked = qualified_name")
def symbols_batch(spark, d):
    return lookup.first_by_name(V.symbols(spark, d), _ASKED).select(F.col("pos").cast("long").alias("pos"), "asked", "path", "line", "error")


def _walk_sql(depth: int, start: str, view: str, kind: str) -> str:
    """One materialized step a level; what a level has seen is looked up by equality."""
    names = "v_names" if view == "v_edges" else f"(SELECT caller AS name FROM {view} UNION SELECT callee FROM {view})"
    steps, out = [f"n AS MATERIALIZED (SELECT DISTINCT name FROM {names})", f"g AS MATERIALIZED (SELECT caller, callee, line, CASE WHEN contains(callee, '.') THEN lower(split_part(callee, '.', -1)) END AS tail FROM {view})", f"s0 AS MATERIALIZED (SELECT '{start}' AS name)"], []
    for k in range(1, depth + 1):
        if kind == "callees":
            steps.append(f"e{k} AS MATERIALIZED (SELECT g.caller, g.callee, n.name AS resolved_name, g.line FROM g JOIN s{k - 1} f ON g.caller = f.name LEFT JOIN n ON n.name = g.callee)")
            out.append(f"SELECT caller, callee, resolved_name, line, {k} AS depth FROM e{k}")
        else:
            steps.append(f"t{k} AS MATERIALIZED (SELECT DISTINCT lower(split_part(name, '.', -1)) AS tail FROM s{k - 1})")
            steps.append(f"e{k} AS MATERIALIZED (SELECT g.caller, g.callee, g.line FROM g LEFT JOIN s{k - 1} f ON g.callee = f.name LEFT JOIN t{k} t ON g.tail = t.tail WHERE f.name IS NOT NULL OR t.tail IS NOT NULL)")
            out.append(f"SELECT caller, callee, line, {k} AS depth FROM e{k}")
        follow = "resolved_name" if kind == "callees" else "caller"
        seen = " ".join(f"AND NOT EXISTS (SELECT 1 FROM s{j} WHERE s{j}.name = e{k}.{follow})" for j in range(k))
        steps.append(f"s{k} AS MATERIALIZED (SELECT DISTINCT {follow} AS name FROM e{k} WHERE {follow} IS NOT NULL {seen})")
    views = ("v_edges", "v_names") if view == "v_edges" else (view,)
    return f"{V.with_views(*views)}, {', '.join(steps)} {' UNION ALL '.join(out)}"


def _walks() -> None:
    for depth in (1, 2, 3):
        def down(spark, d, depth=depth):
            return graph.callees(V.edges(spark, d).drop("rule"), V.names(spark, d), "orders.7", depth)

        def up(spark, d, depth=depth):
            return graph.callers(V.edges(spark, d).drop("rule"), "nation.3" if depth < 3 else "region.2", depth)

        down.__name__, up.__name__ = f"callees_d{depth}", f"callers_d{depth}"
        query(_walk_sql(depth, "orders.7", "v_edges", "callees"))(down)
        query(_walk_sql(depth, "nation.3" if depth < 3 else "region.2", "v_edges", "callers"))(up)


_walks()


@query(_walk_sql(5, "n5", "v_sparse", "callees"))
def callees_sparse(spark, d):
    e = V.sparse_edges(spark, d)
    return graph.callees(e, e.select(F.col("caller").alias("name")).union(e.select("callee")), "n5", 9)


@query(_walk_sql(4, "n5", "v_sparse", "callers"))
def callers_sparse(spark, d):
    return graph.callers(V.sparse_edges(spark, d), "n5", 4)


@query(f"{V.with_views('v_events')}, one AS (SELECT min(caller) AS start FROM v_events), d1 AS (SELECT caller, callee FROM v_events, one WHERE caller = start), d2 AS (SELECT caller, callee FROM v_events, one WHERE caller <> start AND caller IN (SELECT callee FROM d1)) SELECT caller, callee, depth, count(*) AS n FROM (SELECT *, 1 AS depth FROM d1 UNION ALL SELECT *, 2 FROM d2) GROUP BY ALL")
def callees_cyclic(spark, d):
    e = V.event_edges(spark, d)
    start = e.agg(F.min("caller")).first()[0]
    return graph.callees(e, e.select(F.col("caller").alias("name")), start, 2).groupBy("caller", "callee", "depth").agg(F.count("*").alias("n"))


@query(f"{V.with_views('v_files', 'v_lines', 'v_symbols')}, e AS (SELECT qualified_name AS caller, split_part(docstring, ' ', 2) AS callee FROM v_symbols) SELECT caller, callee, (SELECT min(qualified_name) FROM v_symbols WHERE name = callee OR qualified_name = callee) AS callee_id FROM e")
def resolve_edges(spark, d):
    s = V.symbols(spark, d)
    e = s.select(F.col("qualified_name").alias("caller"), F.split_part("docstring", F.lit(" "), F.lit(2)).alias("callee"), F.lit(None).cast("string").alias("callee_id"))
    return graph.resolve(e, s.select("name", "qualified_name", F.col("qualified_name").alias("id")), F.col("qualified_name")).select("caller", "callee", "callee_id")


@query(f"{V.with_views('v_files', 'v_lines', 'v_symbols')} SELECT a.qualified_name AS caller, b.qualified_name AS callee_id FROM v_symbols a LEFT JOIN v_symbols b ON a.doc_id = b.doc_id AND b.qualified_name = a.doc_id || '.' || length(split_part(a.docstring, ' ', 2))")
def resolve_in_file(spark, d):
    s = V.symbols(spark, d)
    callee = F.concat_ws(".", "doc_id", F.length(F.split_part("docstring", F.lit(" "), F.lit(2))).cast("string"))
    known = s.select("doc_id", F.col("qualified_name").alias("callee_id"))
    return s.select("doc_id", F.col("qualified_name").alias("caller"), callee.alias("callee")).join(known.withColumn("callee", F.col("callee_id")), ["doc_id", "callee"], "left").select("caller", "callee_id")


_MAP = "SELECT split_part(caller, '.', 1) AS cf, split_part(callee, '.', 1) AS ef, split_part(caller, '.', 1) || '#' || line AS cn, split_part(callee, '.', 1) || '#' || length(callee) AS en, rule * 1000 + line AS pos FROM v_edges"


@query(f"""{V.with_views('v_edges')}, m AS ({_MAP}), b AS (SELECT cf AS file, 'depends_on' AS direction, ef AS other, en AS name, min(pos) AS pos FROM m GROUP BY ALL UNION ALL SELECT ef, 'depended_by', cf, cn, min(pos) FROM m GROUP BY ALL)
SELECT file, direction, other, string_agg(name, ',' ORDER BY pos, name) AS names FROM b GROUP BY ALL""")
def dependency_map(spark, d):
    e = V.edges(spark, d)
    head = lambda c: F.split_part(c, F.lit("."), F.lit(1))
    e = e.select(head("caller").alias("caller_file"), head("callee").alias("callee_file"), F.concat(head("caller"), F.lit("#"), "line").alias("caller"), F.concat(head("callee"), F.lit("#"), F.length("callee")).alias("callee"), (F.col("rule") * 1000 + F.col("line")).alias("pos"))
    return graph.dependency_map(e).withColumn("names", F.array_join("names", ","))


def _versions(spark, d):
    o = V.table(spark, d, "orders")
    k = F.col("o_orderkey") % 10
    base = [F.concat(F.lit("order."), "o_orderkey").alias("qualified_name"), F.lit("f").alias("path")]
    line, status = (F.col("o_orderkey") % 97).alias("line"), F.col("o_orderstatus")
    old = o.where(k != 0).select(*base, line, status.alias("signature"))
    new = o.where(k != 1).select(*base, F.when(k == 3, F.col("o_orderkey") % 97 + 1).otherwise(F.col("o_orderkey") % 97).alias("line"), F.when(k == 2, F.concat(status, F.lit("x"))).otherwise(status).alias("signature"))
    return old, new


_DIFF = """WITH o AS (SELECT 'order.' || o_orderkey AS q, o_orderkey % 97 AS line, o_orderstatus AS sig FROM orders WHERE o_orderkey % 10 <> 0),
n AS (SELECT 'order.' || o_orderkey AS q, CASE WHEN o_orderkey % 10 = 3 THEN o_orderkey % 97 + 1 ELSE o_orderkey % 97 END AS line, CASE WHEN o_orderkey % 10 = 2 THEN o_orderstatus || 'x' ELSE o_orderstatus END AS sig FROM orders WHERE o_orderkey % 10 <> 1),
x AS (SELECT coalesce(o.q, n.q) AS qualified_name, CASE WHEN o.q IS NULL THEN 'added' WHEN n.q IS NULL THEN 'removed' WHEN o.line <> n.line OR o.sig <> n.sig THEN 'modified' END AS status, o.line AS old_line, n.line AS new_line, o.sig AS old_signature, n.sig AS new_signature FROM o FULL JOIN n ON o.q = n.q)"""


@query(f"{_DIFF} SELECT * FROM x WHERE status IS NOT NULL")
def symbol_diff(spark, d):
    return snapshot.diff_symbols(*_versions(spark, d))


@query(f"{_DIFF} SELECT count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'removed') AS removed, count(*) FILTER (status = 'modified') AS modified FROM x")
def diff_summary(spark, d):
    x = snapshot.diff_symbols(*_versions(spark, d))
    return x.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("added", "removed", "modified")])


def _two(spark, d):
    f = V.files(spark, d)
    k = F.col("doc_id") % 10
    return f.where(k != 0), f.where(k != 1).withColumn("sha256", F.when(k == 2, F.sha2(F.concat("content", F.lit("!")), 256)).otherwise(F.col("sha256")))


_TWO = f"{V.with_views('v_files')}, o AS (SELECT * FROM v_files WHERE doc_id % 10 <> 0), n AS (SELECT * REPLACE (CASE WHEN doc_id % 10 = 2 THEN sha256(content || '!') ELSE sha256 END AS sha256) FROM v_files WHERE doc_id % 10 <> 1), st AS (SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'deleted' WHEN o.sha256 <> n.sha256 THEN 'changed' ELSE 'unchanged' END AS status FROM o FULL JOIN n ON o.path = n.path)"


@query(f"{_TWO} SELECT * FROM st")
def file_status(spark, d):
    return snapshot.file_status(*_two(spark, d))


@query(f"{_TWO} SELECT count(*) FILTER (status <> 'deleted') AS total_files, count(*) FILTER (status IN ('new', 'changed')) AS indexed, count(*) FILTER (status = 'unchanged') AS skipped_unchanged, count(*) FILTER (status = 'deleted') AS deleted FROM st")
def run_counters(spark, d):
    return snapshot.counters(snapshot.file_status(*_two(spark, d)))


@query(f"{_TWO}, c AS (SELECT path FROM st WHERE status IN ('new', 'changed', 'deleted')) SELECT path, sha256 FROM o WHERE path NOT IN (SELECT path FROM c) UNION ALL SELECT path, sha256 FROM n WHERE path IN (SELECT path FROM c)")
def incremental_upsert(spark, d):
    old, new = _two(spark, d)
    status = snapshot.file_status(old, new)
    left = snapshot.delete(old, status.where("status = 'deleted'"), "path")
    return snapshot.upsert(left, new.join(status.where("status IN ('new', 'changed')").select("path"), "path", "left_semi")).select("path", "sha256")


@query("""WITH s AS (SELECT c_custkey AS id, c_nationkey AS file_id FROM customer), kept AS (SELECT * FROM s WHERE file_id NOT IN (3, 4)), e AS (SELECT o_orderkey AS edge, o_custkey AS caller_id, (o_custkey * 7) % 150 AS callee_id FROM orders)
SELECT edge, caller_id, CASE WHEN callee_id IN (SELECT id FROM kept) THEN callee_id END AS callee_id FROM e WHERE caller_id IN (SELECT id FROM kept)""")
def cascade_delete(spark, d):
    s = V.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("file_id"))
    e = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("edge"), F.col("o_custkey").alias("caller_id"), (F.col("o_custkey") * 7 % 150).alias("callee_id"))
    gone = s.where("file_id IN (3, 4)").select("file_id").distinct()
    return snapshot.cascade(s, e, None, gone)[1]


def _secret_sql() -> str:
    cases = ", ".join(f"CASE WHEN regexp_matches(text, '{('(?i)' if f else '') + p.replace(chr(39), chr(39) * 2)}') THEN '{f'Potential secret found matching pattern: {p[:40]}...'.replace(chr(39), chr(39) * 2)}' END" for p, f in K.SECRET_PATTERNS)
    return f"SELECT doc_id, array_to_string(list_filter([{cases}], lambda x: x IS NOT NULL), '; ') AS warnings FROM documents"


@query(_secret_sql())
def secret_patterns(spark, d):
    return V.table(spark, d, "documents").select("doc_id", F.array_join(scalars.secret_warnings(F.col("text")), "; ").alias("warnings"))


@query(f"{V.with_views('v_files')} SELECT path, (size_bytes > 4096 OR doc_id % 7 IN (1, 2)) AS rejected FROM v_files")
def binary_or_large_filter(spark, d):
    f = V.files(spark, d).withColumn("path2", F.when(F.col("doc_id") % 7 == 1, F.concat("path", F.lit(".PNG"))).otherwise(F.col("path")))
    content = F.when(F.col("doc_id") % 7 == 2, F.concat(F.unhex(F.lit("7f454c46")), F.encode("content", "UTF-8"))).otherwise(F.encode("content", "UTF-8"))
    return f.select("path", ((F.col("size_bytes") > 4096) | scalars.is_binary(F.col("path2"), content)).alias("rejected"))


_EXT = [*K.LANGUAGE_OF_SUFFIX, ".txt", ".json", ".PY"]


@query(f"WITH p AS (SELECT doc_id, source || '/f' || (['{chr(39).join(_EXT).replace(chr(39), chr(39) + ', ' + chr(39))}'])[doc_id % {len(_EXT)} + 1] AS path FROM documents) SELECT doc_id, path, map_extract(MAP {{{', '.join(f'{k!r}: {v!r}' for k, v in K.LANGUAGE_OF_SUFFIX.items())}}}, lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1)))[1] AS language FROM p")
def language_of_path(spark, d):
    ext = F.element_at(F.array(*[F.lit(e) for e in _EXT]), (F.col("doc_id") % len(_EXT) + 1).cast("int"))
    return V.table(spark, d, "documents").select("doc_id", F.concat("source", F.lit("/f"), ext).alias("path")).withColumn("language", scalars.language_of_path(F.col("path")))


@query("""WITH u AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://github.com/o' || page_id || '/r' || page_id || '.git' WHEN 1 THEN 'gitlab.com/g/sub' || page_id || '/r' || page_id WHEN 2 THEN ' https://git.example.org/x/r' || page_id || ' ' ELSE 'nothing here' END AS url FROM pages)
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'github.com' WHEN 1 THEN 'gitlab.com' WHEN 2 THEN 'git.example.org' END AS host, CASE page_id % 4 WHEN 0 THEN 'o' || page_id WHEN 1 THEN 'g/sub' || page_id WHEN 2 THEN '' END AS owner, CASE WHEN page_id % 4 < 3 THEN 'r' || page_id END AS repo, CASE page_id % 4 WHEN 0 THEN 'github' WHEN 1 THEN 'gitlab' WHEN 2 THEN 'generic' END AS url_type FROM u""")
def url_parse(spark, d):
    url = F.expr("CASE page_id % 4 WHEN 0 THEN 'https://github.com/o' || page_id || '/r' || page_id || '.git' WHEN 1 THEN 'gitlab.com/g/sub' || page_id || '/r' || page_id WHEN 2 THEN ' https://git.example.org/x/r' || page_id || ' ' ELSE 'nothing here' END")
    return V.table(spark, d, "pages").select("page_id", scalars.parse_repo_url(url).alias("u")).select("page_id", "u.*")


@query(f"{V.with_views('v_files', 'v_lines', 'v_symbols')} SELECT qualified_name, concat_ws(' | ', nullif(language, ''), kind || ': ' || name, nullif(signature, ''), nullif(substring(docstring, 1, 200), '')) AS embed_text FROM v_symbols")
def embed_text_format(spark, d):
    return V.symbols(spark, d).select("qualified_name", scalars.embed_text(F.col("language"), F.col("kind"), F.col("name"), F.col("signature"), F.col("docstring")).alias("embed_text"))


@query("SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def rel_join_agg(spark, d):
    return V.table(spark, d, "orders").join(V.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


_IGNORE = ["src1*", "!src12", "**/de/**", "*7.txt"]


@query(f"{V.with_views('v_files')} SELECT path FROM v_files WHERE NOT (CASE WHEN path LIKE '%7.txt' THEN true WHEN path LIKE '%/de/%' THEN true WHEN path LIKE 'src12/%' THEN false WHEN path LIKE 'src1%' THEN true ELSE false END)")
def ignore_filter(spark, d):
    return V.files(spark, d).where(~scalars.ignored(F.col("path"), _IGNORE)).select("path")


@query(f"{V.with_views('v_files')} SELECT path FROM v_files WHERE starts_with(path, 'src2') OR starts_with(path, 'src3/en')")
def sparse_filter(spark, d):
    return V.files(spark, d).where(scalars.has_prefix(F.col("path"), ["src2/", "src3/en"])).select("path")


@query(f"{V.with_views('v_files')} SELECT path, sha256, substring(sha256(path), 1, 12) AS repo_id FROM v_files")
def content_hash(spark, d):
    return V.files(spark, d).select("path", "sha256", scalars.repo_id(F.col("path")).alias("repo_id"))


@query(f"{V.with_views('v_edges')} SELECT callee, count(*) AS n FROM v_edges WHERE lower(callee) LIKE '%.1_' AND callee GLOB '*[pn]*' GROUP BY callee")
def like_and_glob(spark, d):
    c = F.col("callee")
    return V.edges(spark, d).where(c.rlike(patterns.like_regex("%.1_")) & c.rlike(patterns.glob_regex("*[pn]*"))).groupBy("callee").agg(F.count("*").alias("n"))


@query(f"WITH {_bm25('documents', ['text'], WORDS)} SELECT doc_id, score FROM h ORDER BY score DESC, doc_id LIMIT 20")
def fts_postings_bm25(spark, d):
    """`fts_phrase_bm25` by the persisted index."""
    docs, at = V.table(spark, d, "documents").select("doc_id", "text"), scratch.folder(spark)
    postings.write(postings.occurrences(docs, "doc_id", ["text"]), f"{at}-terms")
    found = postings.read(spark, f"{at}-terms", "long")
    return postings.search(found, postings.lengths(docs, "doc_id", ["text"]), PHRASE, 20).withColumnRenamed("key", "doc_id")


_DEFINED = f"d AS (SELECT qualified_name, min(kind) AS kind, min(line) AS line, min(path) AS path FROM ({V.SQL['v_definitions']}) GROUP BY 1)"


@query(_walk_sql(2, "orders.7", "v_edges", "callees").replace("WITH ", f"WITH {_DEFINED}, w AS (WITH ", 1) + ") SELECT w.*, d.kind, d.line AS def_line, d.path AS def_file FROM w LEFT JOIN d ON d.qualified_name = w.resolved_name")
def callees_definitions(spark, d):
    rows = graph.callees(V.edges(spark, d).drop("rule"), V.names(spark, d), "orders.7", 2)
    return graph.with_definitions(rows, V.definitions(spark, d), "resolved_name", "def")


@query(_walk_sql(2, "nation.3", "v_edges", "callers").replace("WITH ", f"WITH {_DEFINED}, w AS (WITH ", 1) + ") SELECT w.*, d.kind, d.line AS caller_line, d.path AS caller_file FROM w LEFT JOIN d ON d.qualified_name = w.caller")
def callers_definitions(spark, d):
    rows = graph.callers(V.edges(spark, d).drop("rule"), "nation.3", 2)
    return graph.with_definitions(rows, V.definitions(spark, d), "caller", "caller")


@query("SELECT caller, callee, line, 1 AS depth FROM (SELECT c_name || '.get_' || c_mktsegment AS caller, 'm' || c_custkey || '.' || replace(c_mktsegment, 'I', CASE WHEN c_custkey % 2 = 0 THEN '_' ELSE 'x' END) || '_by' || (['_id', 'xid', '_key'])[c_custkey % 3 + 1] AS callee, 1 AS line FROM customer) WHERE lower(callee) LIKE '%.bu_ld_ng_by_id'")
def callers_wildcards(spark, d):
    callee = F.expr("'m' || c_custkey || '.' || replace(c_mktsegment, 'I', IF(c_custkey % 2 = 0, '_', 'x')) || '_by' || element_at(array('_id', 'xid', '_key'), int(c_custkey % 3) + 1)")
    e = V.table(spark, d, "customer").select(F.expr("c_name || '.get_' || c_mktsegment").alias("caller"), callee.alias("callee"), F.lit(1).alias("line"))
    return graph.callers(e, "Some.BU_LD_NG_by_id", 1)


@query(f"SELECT d.* FROM ({V.SOURCES_SQL}) d")
def extract_python(spark, d):
    """Files with Unix and DOS line ends, malformed bytes, and letters of several bytes."""
    files = V.sources(spark, d)
    s = lookup.source(extract.extract_symbols(files), files)
    return s.select("path", "qualified_name", "kind", "signature", "docstring", scalars.json_list(F.col("decorators")).alias("decorators"), "parent_name", "line", "end_line", "byte_offset", "byte_length", F.sha2("source", 256).alias("source_sha"))


@query("SELECT doc_id || '.py' AS path, 'f' || doc_id AS caller, 'g' || doc_id || '.h' AS callee, 5 AS line FROM documents UNION ALL SELECT doc_id || '.py', 'C' || doc_id || '.m', 'self.n', 8 FROM documents")
def extract_calls(spark, d):
    s = extract.extract_symbols(V.sources(spark, d))
    return s.select("path", F.col("qualified_name").alias("caller"), F.explode("calls").alias("c")).select("path", "caller", F.col("c.callee_name").alias("callee"), F.col("c.line").alias("line"))


_JS = [("// Adds ", " to a.\n"), ("function add", "(a, b) {\n  return sum(a, b);\n}\n"), ("class Calc", " {\n  @Log()\n  twice(x) { return this.add", "(x, x); }\n}\n")]
_N = "length(doc_id::VARCHAR)"


@query(f"""WITH s AS (SELECT doc_id, doc_id || '.ts' AS path, {len(''.join(_JS[0]))} + {_N} AS a, {len(''.join(_JS[1])) - 1} + {_N} AS f, {len(''.join(_JS[2])) - 1} + 2 * {_N} AS c FROM documents)
SELECT path, 'add' || doc_id AS qualified_name, 'function' AS kind, 'add' || doc_id || ' (a, b)' AS signature, 'Adds ' || doc_id || ' to a.' AS docstring, NULL AS decorators, 2 AS line, 4 AS end_line, a::BIGINT AS byte_offset, f::BIGINT AS byte_length, '[{{"callee_name":"sum","line":3}}]' AS calls FROM s
UNION ALL SELECT path, 'Calc' || doc_id, 'class', 'Calc' || doc_id, '', NULL, 5, 8, a + f + 1, c, '[{{"callee_name":"Log","line":6}}]' FROM s
UNION ALL SELECT path, 'Calc' || doc_id || '.twice', 'method', 'twice (x)', '', '["@Log()"]', 7, 7, a + f + 1 + {len(_JS[2][0] + _JS[2][1].partition('twice')[0])} + {_N}, {len('twice' + _JS[2][1].partition('twice')[2] + _JS[2][2]) - 3} + {_N}, '[{{"callee_name":"this.add' || doc_id || '","line":7}}]' FROM s""")
def extract_typescript(spark, d):
    text = F.concat(*[F.concat(*[x for k, part in enumerate(parts) for x in ([F.col("doc_id").cast("string")] if k else []) + [F.lit(part)]]) for parts in _JS])
    files = V.table(spark, d, "documents").select(F.concat("doc_id", F.lit(".ts")).alias("path"), F.lit("typescript").alias("language"), text.alias("content"))
    s = extract.extract_symbols(files)
    return s.select("path", "qualified_name", "kind", "signature", "docstring", scalars.json_list(F.col("decorators")).alias("decorators"), "line", "end_line", "byte_offset", "byte_length", scalars.json_list(F.col("calls")).alias("calls"))


_PATHS = ["src/a.py", ".hidden/b.py", "node_modules/x/c.js", "src/gen/d.rb", "src/e.txt", "lib/f.GO", "src/.dot/g.py", "pkg.egg-info/h.py", "src/i.min.js"]
_SIZE = f"{K.MAX_FILE_BYTES} + doc_id % 3 - 1"


@query(f"WITH p AS (SELECT doc_id, ({_PATHS!r})[doc_id % {len(_PATHS)} + 1] AS path, {_SIZE} AS size_bytes FROM documents) SELECT doc_id, path FROM p WHERE path IN ('src/a.py') AND size_bytes <= {K.MAX_FILE_BYTES}")
def walk_filters(spark, d):
    """Include, exclude and ignore patterns, hidden folders, languages, and the edge of the size limit."""
    path = F.element_at(F.array(*[F.lit(p) for p in _PATHS]), (F.col("doc_id") % len(_PATHS) + 1).cast("int"))
    f = V.table(spark, d, "documents").select("doc_id", path.alias("path"), F.expr(_SIZE).alias("size_bytes"))
    return files.keep_path(f, ["src/"], ["*.min.js"], ["gen/"]).select("doc_id", "path")


_MANY = [f"{k}.1" for k in range(1, 61)]


@query(f"{V.with_views('v_files', 'v_lines', 'v_symbols')}, asked AS (SELECT unnest({_MANY[:K.MAX_BATCH]!r}) AS asked, unnest(range(0, {K.MAX_BATCH})) AS pos) SELECT pos, asked, path, line FROM asked LEFT JOIN v_symbols ON asked = qualified_name")
def symbols_batch_cap(spark, d):
    return lookup.first_by_name(V.symbols(spark, d), _MANY).select(F.col("pos").cast("long").alias("pos"), "asked", "path", "line")


_URLS = [
    ("https://github.com/o/r", "github.com|o|r|github"), ("http://github.com/o/r.git", "github.com|o|r|github"), ("github.com/o/r/tree/main/src", "github.com|o|r|github"), ("github.com/o/r/", "github.com|o|r|github"),
    ("https://gitlab.com/g/s/t/r.git", "gitlab.com|g/s/t|r|gitlab"), ("gitlab.com/g/r/", "gitlab.com|g|r|gitlab"), ("gitlab.com/g/r/x.y", "gitlab.com|g|r|gitlab"), ("\t https://github.com/o/r\n", "github.com|o|r|github"),
    ("https://git.example.org/a/b/c.git", "git.example.org||c|generic"), ("git.example.org/a/b.c", "git.example.org||c|generic"), ("github.com/o", "github.com||o|generic"), ("github.com/o/r.x", "github.com||x|generic"),
    ("https://gitlab.com/g//r", "gitlab.com||r|generic"), ("nothing here", None), ("github.com/", None), ("", None), ("host/a/.git", "host||git|generic"),
]
_URL_LIST = ", ".join("'" + u.replace("\t", "\\t").replace("\n", "\\n") + "'" for u, _ in _URLS)


@query(f"SELECT page_id, ([{', '.join('NULL' if x is None else repr(x) for _, x in _URLS)}])[page_id % {len(_URLS)} + 1] AS parsed FROM pages")
def url_parse_forms(spark, d):
    url = F.expr(f"element_at(array({_URL_LIST}), int(page_id % {len(_URLS)}) + 1)")
    u = V.table(spark, d, "pages").select("page_id", scalars.parse_repo_url(url).alias("u"))
    return u.select("page_id", F.when(F.col("u").isNotNull(), F.concat_ws("|", "u.host", "u.owner", "u.repo", "u.url_type")).alias("parsed"))


@query("SELECT page_id, regexp_replace('own.er ' || page_id || '_' || url, '[^a-zA-Z0-9_-]', '_', 'g') AS name FROM pages")
def cache_names(spark, d):
    return V.table(spark, d, "pages").select("page_id", scalars.cache_name(F.concat(F.lit("own.er "), "page_id"), F.col("url")).alias("name"))


@query(f"{V.with_views('v_files')} SELECT 'language' AS metric, string_agg(language || '=' || n, ',' ORDER BY language) AS counts FROM (SELECT language, count(*) AS n FROM v_files WHERE language IS NOT NULL GROUP BY 1)")
def counts_by_language(spark, d):
    f = V.files(spark, d)
    stats = lookup.repo_stats(f, f.select(F.lit("x").alias("kind")).limit(0), f.select(F.lit(1).alias("callee_id")).limit(0))
    pairs = F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return lookup.as_maps(stats).select("metric", F.array_join(pairs, ",").alias("counts"))


@query(f"{V.with_views('v_edges')}, m AS (SELECT DISTINCT split_part(caller, '.', 1) AS cf, split_part(callee, '.', 1) AS ef FROM v_edges) SELECT file, (SELECT count(*) FROM m WHERE cf = file) AS depends_on_files, (SELECT count(*) FROM m WHERE ef = file) AS depended_by_files FROM (SELECT cf AS file FROM m UNION SELECT ef FROM m)")
def dependency_counts(spark, d):
    return lookup.file_counts(dependency_map(spark, d))


# An index that is brought up to date: rows that a later run changes, adds or takes back.


def _edited(symbols: DataFrame, new: bool) -> DataFrame:
    """Documents of one remainder come later, of another go, and of a third have other names before."""
    if new:
        return symbols.where("doc_id % 13 <> 4")
    return symbols.where("doc_id % 11 <> 5").withColumn("name", F.when(F.col("doc_id") % 7 == 3, F.concat(F.lit("x"), "name")).otherwise(F.col("name")))


@query(f"""{V.with_views('v_files', 'v_lines', 'v_symbols')}, s AS (SELECT *, split_part(docstring, ' ', 2) AS callee FROM v_symbols WHERE doc_id % 13 <> 4),
k AS (SELECT name AS key, path, line, qualified_name FROM s UNION SELECT qualified_name, path, line, qualified_name FROM s), w AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY path, line) = 1)
SELECT s.path, s.qualified_name AS caller, s.line::INTEGER AS line, s.callee, coalesce(l.qualified_name, w.qualified_name) AS resolved_name, coalesce(l.path, w.path) AS def_file
FROM s LEFT JOIN w ON s.callee = w.key LEFT JOIN s l ON l.path = s.path AND l.qualified_name = s.callee""")
def resolve_incremental(spark, d):
    """Calls resolved in one run, then only what a second run's changes touch; the same as resolving all anew."""
    base = scratch.folder(spark)
    call = F.array(F.struct(F.col("callee").alias("callee_name"), F.col("line").cast("int").alias("line")))
    # Ids go by path, and an edit takes or leaves a path's symbols together: they are made once, and kept without texts.
    made = resolution.with_ids(V.calling(spark, d).select("doc_id", "path", "kind", "qualified_name", "name", "line", "byte_offset", "callee"), F.lit(""))
    every = scratch.save(made, f"{base}/symbols").withColumn("calls", call)
    before = _edited(every, False)
    first = Segments(spark, base, None, "a")
    first.add("names", resolution.name_index(before), ["key"])
    first.add("edges", resolution.resolve(resolution.calls_of(before), resolution.winners(resolution.name_index(before))), ["caller", "line"])
    second = Segments(spark, base, first.state, "b")
    docs = V.files(spark, d).select("doc_id", "path")
    dead = docs.where("doc_id % 11 <> 5 AND (doc_id % 7 = 3 OR doc_id % 13 = 4)").select("path")
    now = _edited(every, True).where("doc_id % 11 = 5 OR doc_id % 7 = 3")
    edges, replaced = resolution.update(first.live("edges"), first.live("names"), dead, now, lambda df, name: scratch.save(df, f"{base}/{name}"))
    second.add("names", resolution.name_index(now), ["key"])
    second.add("edges", edges, ["caller", "line"])
    second.bury("dead_paths", dead)
    second.bury("dead_calls", replaced)
    return second.live("edges").select("path", "caller", "line", "callee", "resolved_name", "def_file")


@query(f"WITH v AS (SELECT doc_id, text FROM documents WHERE doc_id % 9 <> 4), {_bm25('v', ['text'], WORDS)} SELECT doc_id, score FROM h ORDER BY score DESC, doc_id LIMIT 50")
def fts_after_edits(spark, d):
    """Postings in segments: some texts changed, came or went after the first; two more runs change some again."""
    base, docs = scratch.folder(spark), V.table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), "text")
    other = lambda text: docs.withColumn("text", F.lit(text))
    runs = [  # what is written, and whose earlier rows go
        (docs.where("doc_id % 7 <> 2 AND doc_id % 5 <> 1").unionByName(other("of the of the").where("doc_id % 7 <> 2 AND doc_id % 5 = 1")), None),
        (docs.where("doc_id % 7 = 2").unionByName(other("the of the").where("doc_id % 7 <> 2 AND doc_id % 5 = 1")), "doc_id % 7 <> 2 AND doc_id % 5 = 1 OR doc_id % 9 = 4"),
        (docs.where("doc_id % 5 = 1 AND doc_id % 9 <> 4"), "doc_id % 5 = 1 OR doc_id % 9 = 4"),
    ]
    held = None
    for k, (rows, gone) in enumerate(runs):
        held = Segments(spark, base, held and held.state, f"v{k}")
        lens = held.add("lens", postings.lengths(rows, "doc_id", ["text"], "path"), ["key"])
        held.add("terms", postings.occurrences(rows, "doc_id", ["text"], "path"), postings.ORDER, rows=lens.agg(F.sum("len")).first()[0] or 0)
        if gone:
            held.bury("dead_paths", docs.where(gone))
    held = held.merge("lens", "merged") or held
    return postings.search(held.live("terms"), held.live("lens"), PHRASE, 50).withColumnRenamed("key", "doc_id")


@query(f"{_KNN} ORDER BY distance, vec_id LIMIT 20")
def vector_knn_clusters(spark, d):
    """`vector_knn_l2` by clusters."""
    vectors = V.table(spark, d, "embeddings").select("vec_id", "embedding")
    held = clusters.centres(vectors, "embedding")
    placed = scratch.save(clusters.assigned(vectors, "embedding", held).repartitionByRange("cluster", "away").sortWithinPartitions("cluster", "away"), scratch.folder(spark))
    return clusters.nearest(placed, held, _vector(spark, d), "vec_id", "embedding")[0].select("vec_id", "distance")


@query("""SELECT q.vec_id AS query_id, e.vec_id, round(list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS distance,
row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6), e.vec_id)::INTEGER AS rank
FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0 QUALIFY rank <= 10""")
def vector_knn_all(spark, d):
    """Nearest rows of every fiftieth vector."""
    vectors = V.table(spark, d, "embeddings").select("vec_id", "embedding")
    held = clusters.centres(vectors, "embedding")
    placed = scratch.save(clusters.assigned(vectors, "embedding", held).repartitionByRange("cluster", "away").sortWithinPartitions("cluster", "away"), scratch.folder(spark))
    queries = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return clusters.nearest_all(placed, held, queries, "vec_id", "embedding", 10).drop("read")


@query(f"WITH {_bm25('documents', ['text'], ['de'])} SELECT doc_id, score FROM h ORDER BY score DESC, doc_id LIMIT 20")
def fts_ranked_term(spark, d):
    """One term's best hits, found by the directory of its postings."""
    docs, at = V.table(spark, d, "documents").select("doc_id", "text"), scratch.folder(spark)
    lens = scratch.save(postings.lengths(docs, "doc_id", ["text"]), f"{at}-lens")
    n, total = lens.agg(F.count("*"), F.sum("len")).first()
    postings.write(postings.occurrences(docs, "doc_id", ["text"]), f"{at}-terms", total or 0)
    found = postings.read(spark, f"{at}-terms", "long")
    directory = scratch.save(ranked.chunks(found, lens), f"{at}-chunks")
    return ranked.search(found, lens, directory, "de", 20, n, total)[0].withColumnRenamed("key", "doc_id")


@query("SELECT 'u' || user_id AS path, event_type || '-' || event_id AS sha256, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type || '-' || event_id DESC) = 1")
def stream_latest(spark, d):
    """Each user's last event, kept up to date by a stream of three batches in which late rows lose."""
    at = scratch.folder(spark)
    rows = V.table(spark, d, "events").select(F.concat(F.lit("u"), "user_id").alias("path"), F.concat_ws("-", "event_type", "event_id").alias("sha256"), F.col("ts").alias("modificationTime"), "value", (F.col("event_id") % 3).alias("part"))
    for k in (1, 2, 0):  # not in the order of their times
        rows.where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(f"{at}/in")
    source = spark.readStream.schema(rows.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    ingest.merge_stream(source, f"{at}/table").trigger(availableNow=True).option("checkpointLocation", f"{at}/progress").start().awaitTermination()
    return ingest.current(spark, f"{at}/table").select("path", "sha256", "value")


@query()
def callees_depth_first(spark, d):
    """A depth-first walk; SQL has no visited set, so tests compare it with a recursive one."""
    e = V.sparse_edges(spark, d)
    return graph.callees_depth_first(e, e.select(F.col("caller").alias("name")), "n1", 5)


@query(r"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(regexp_replace(regexp_replace(text, '([\p{Ll}\p{N}])(\p{Lu})', '\1 \2', 'g'), '(\p{Lu})(\p{Lu}\p{Ll})', '\1 \2', 'g')), '[\p{L}\p{M}]+|\p{N}+') AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM t), h AS (SELECT doc_id, i, (('0x' || left(md5(w), 8))::BIGINT % 16384)::INT AS b FROM u),
p AS (SELECT b AS x, unnest([lead(b, 1) OVER o, lead(b, 2) OVER o, lead(b, 3) OVER o, lead(b, 4) OVER o]) AS y, unnest([4, 3, 2, 1]) AS n FROM h WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
m AS (SELECT x, y, n FROM p WHERE y IS NOT NULL UNION ALL SELECT y, x, n FROM p WHERE y IS NOT NULL)
SELECT x AS bucket, sum(n)::BIGINT AS n, count(DISTINCT y) AS contexts FROM m GROUP BY x""")
def embed_contexts(spark, d):
    """What the embedder's matrix holds of each bucket: its weight, and how many buckets it meets."""
    texts = V.table(spark, d, "documents").select(embedding.buckets(F.col("text")).alias("words"))
    return embedding.marginals(embedding.context_counts(texts, "words"))


@query()
def hybrid_learnt(spark, d):
    """Phrase search fused with the nearest learnt vectors, over documents; tests hold the vectors against a dense decomposition."""
    docs, at = V.table(spark, d, "documents").select("doc_id", "text"), scratch.folder(spark)
    words = scratch.save(docs.select("doc_id", embedding.buckets(F.col("text")).alias("words")), f"{at}-words")
    model = embedding.fit(words, "words")
    vectors = embedding.embedded(words, F.col("words"), model).where("embedding IS NOT NULL").select("doc_id", "embedding")
    held = scratch.save(model.table(spark), f"{at}-model")
    near = search.nearest(vectors, embedding.ask(spark, PHRASE, held), "doc_id", "embedding", 40)
    found = search.search_phrase(docs, ["text"], PHRASE, "doc_id", 40)
    arms = [search.ranked(found, F.desc("score"), "doc_id"), search.ranked(near, "distance", "doc_id")]
    return search.fuse([a.select("doc_id", F.lit("text").alias("kind"), "pos") for a in arms], "doc_id", 20)
