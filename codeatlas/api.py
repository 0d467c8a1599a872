"""An index of one or more repositories as versioned Parquet tables, and the questions one can ask of it."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import constants as K
from . import scratch
from .functions import scalars
from .functions.patterns import glob_regex
from .operators import clusters, embedding, graph, lookup, postings, ranked, resolution, search, snapshot
from .operators.segments import Segments
from .sources import extract, files

Embedder = Callable[[Sequence[str]], list[list[float]]]
#: A change of at most so many files makes segments of one file each.
FEW = 1000
#: What the phrase indexes cover.
TEXT_COLUMNS, NAME_COLUMNS = ("path", "content"), ("name", "qualified_name", "signature", "docstring")


class NotFound(LookupError):
    """No such repository, file or symbol."""


class Index:
    """Tables under `home`, a folder that driver and executors share: <repo_id>/<version>/<table>-<segment>; the newest manifest lists the segments.

    A run writes segments of what has changed under a new version and then the next manifest; what a query reads is never
    overwritten. What the newest manifest and the one before it list stays, the rest is removed.

    Without an embedder, `embed` learns one from the symbols of the first run that asks for it (`operators/embedding.py`); its
    model is a table of the index, which later runs and queries use, whether an embedder is passed then or not, until
    `invalidate_cache`. An index that holds vectors of a passed embedder learns none.
    """

    def __init__(self, spark: SparkSession, home: str, embedder: Embedder | None = None):
        self.spark, self.home, self.embedder = spark, home.rstrip("/"), embedder

    # Tables and manifests.

    def _id(self, repo: str) -> str:
        return hashlib.sha256(repo.encode()).hexdigest()[:12]

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _manifests(self, folder: str) -> list[str]:
        """Paths of a repository's manifests, oldest first."""
        fs, at = self._fs(folder)
        found = [f.getPath() for f in fs.listStatus(at)] if fs.exists(at) else []
        return [p.toString() for p in sorted((p for p in found if p.getName().startswith("manifest-")), key=lambda p: p.getName())]

    def _manifest(self, repo: str) -> dict | None:
        found = self._manifests(f"{self.home}/{self._id(repo)}")
        return json.loads(self.spark.read.text(found[-1], wholetext=True).first()[0]) if found else None

    def _publish(self, repo: str, manifest: dict) -> None:
        """The next manifest appears by one rename to a name that nothing has yet."""
        folder = f"{self.home}/{self._id(repo)}"
        held = self._manifests(folder)
        number = int(held[-1].rpartition("-")[2]) + 1 if held else 0
        fs, fresh = self._fs(f"{folder}/new-{uuid.uuid4().hex}")
        out = fs.create(fresh)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        _, at = self._fs(f"{folder}/manifest-{number:09d}")
        if fs.exists(at) or not fs.rename(fresh, at):
            fs.delete(fresh, False)
            raise RuntimeError(f"Another run published {at.toString()} meanwhile")
        keep = {manifest["version"], *Segments(self.spark, folder, manifest["state"]).versions(), *manifest.get("kept", ())}
        for old in held[:-1]:
            fs.delete(self._fs(old)[1], False)
        for f in fs.listStatus(self._fs(folder)[1]):
            if f.isDirectory() and f.getPath().getName() not in keep:
                fs.delete(f.getPath(), True)

    def _segments(self, repo: str) -> Segments:
        m = self._manifest(repo)
        if not m:
            raise NotFound(f"Not indexed: {repo}")
        return Segments(self.spark, f"{self.home}/{self._id(repo)}", m["state"])

    def table(self, repo: str, name: str) -> DataFrame:
        return self._segments(repo).live(name).drop("gen")

    def files(self, repo: str) -> DataFrame:
        return self.table(repo, "files")

    def symbols(self, repo: str) -> DataFrame:
        return self.table(repo, "symbols")

    def edges(self, repo: str) -> DataFrame:
        return self.table(repo, "edges")

    # 1, 2: indexing.

    def index_folder(self, path: str, include: Sequence[str] = (), exclude: Sequence[str] = (), embed: bool = False) -> dict:
        root = files.validate_path(path)
        scan = lambda only=None: files.scan_directory(self.spark, root, include, exclude, only)
        return self._update(root, scan(), embed, {}, scan)

    def index_repo(self, url: str, archive: str, branch: str = "", sparse: Sequence[str] = (), sha: str = "", embed: bool = False) -> dict:
        """Index a repository's downloaded archive; skipped where the manifest has the same commit."""
        parsed = self.spark.range(1).select(scalars.parse_repo_url(F.lit(url)).alias("u")).first()["u"]
        if parsed is None:
            raise ValueError(f"Cannot parse repository URL: {url}")
        m = self._manifest(url)
        extra = {"repo_url": url, "branch": branch, "sha": sha, "local_path": archive}
        if m and sha and m.get("sha") == sha:
            return {"cached": True, **extra}
        return {"cached": False, **self._update(url, files.scan_archive(self.spark, archive, sparse), embed, extra)}

    def _update(self, repo: str, scanned: DataFrame, embed: bool, extra: dict, again: Callable[[DataFrame], DataFrame] | None = None) -> dict:
        """Bring the index to what `scanned` holds. again: reads some paths once more, so that contents of unchanged files move nowhere."""
        m = self._manifest(repo)
        base, version = f"{self.home}/{self._id(repo)}", uuid.uuid4().hex
        old, new = Segments(self.spark, base, m and m["state"]), Segments(self.spark, base, m and m["state"], version)
        scratch_at = f"{base}/{version}/scratch"
        save = lambda df, name: scratch.save(df, f"{scratch_at}/{name}")
        # A file that can't be read now stays as it was indexed.
        now = scanned.select("path", "sha256")
        before = old.live("files").select("path", "sha256") if m else now.limit(0)
        status = snapshot.file_status(before, now, unread=True).persist()
        stats = snapshot.counters(status.where("status <> 'unread'")).first().asDict() | {"errors": status.where("blank").count()}
        if m and not stats["indexed"] and not stats["deleted"]:
            status.unpersist()
            if any(m.get(k) != v for k, v in extra.items()):
                self._publish(repo, m | extra)
            return stats | {"symbols_extracted": 0, "call_edges_resolved": 0}
        small = stats["indexed"] <= FEW
        fresh = save(status.where("status IN ('new', 'changed')").select("path"), "fresh")
        read = (again or (lambda only: scanned.join(only, "path", "left_semi")))(fresh).where("content IS NOT NULL")
        found = new.add("files", read.withColumn("indexed_at", F.current_timestamp()), ["path"], small)
        dead = save(status.where("status IN ('changed', 'deleted')").select("path"), "dead")
        symbols = resolution.with_ids(extract.extract_symbols(found), F.lit(repo))
        shown = scalars.embed_text(F.col("language"), F.col("kind"), F.col("name"), F.col("signature"), F.col("docstring"))
        own = any(old.rows("model"))
        if embed and not own and not self.embedder and not any(old.rows("vectors")):
            symbols, own = save(symbols, "symbols"), True
            held_too = old.live("symbols").join(dead, "path", "left_anti") if m else symbols.limit(0)
            learnt = symbols.select(embedding.buckets(shown).alias("words")).unionByName(held_too.select(embedding.buckets(shown).alias("words")))
            new.add("model", embedding.fit(learnt, "words").table(self.spark), ["bucket"], True)
        if embed and own:
            symbols = embedding.embedded(symbols, embedding.buckets(shown), embedding.read(new.live("model")))
        elif embed and self.embedder:
            symbols = symbols.withColumn("embedding", _embed(shown, self.embedder))
        else:
            symbols = symbols.withColumn("embedding", F.lit(None).cast("array<float>"))
        symbols = new.add("symbols", symbols, ["path", "line"], small)
        held = (m or {}).get("centres", [])
        vectors = symbols.where("embedding IS NOT NULL").select("id", "path", "embedding")
        held = held or (clusters.centres(vectors, "embedding") if embed and (own or self.embedder) else [])
        new.add("vectors", clusters.assigned(vectors, "embedding", held), ["cluster", "away"], small)
        if m:
            edges, replaced = resolution.update(old.live("edges"), old.live("names"), dead, symbols, save)
        else:
            edges, replaced = resolution.resolve(resolution.calls_of(symbols), resolution.winners(resolution.name_index(symbols))), None
        new.add("names", resolution.name_index(symbols), ["key"], small)
        edges = new.add("edges", edges, ["caller", "line"])
        totals, text = {}, found.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
        for name, key, table, columns, carried in (("text", "path", text, TEXT_COLUMNS, [F.col("path")]), ("names", "id", symbols, NAME_COLUMNS, ["path"])):
            terms = new.add(f"{name}_terms", postings.occurrences(table.withColumn("of", F.col("path")), key, columns, "of").withColumnRenamed("of", "path"), postings.ORDER, small)
            lens = new.add(f"{name}_lens", postings.lengths(table.withColumn("of", F.col("path")), key, columns, "of").withColumnRenamed("of", "path"), ["key"], small)
            new.add(f"{name}_chunks", ranked.chunks(terms, lens), ["term", "first"], small)
            n, total = lens.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
            if m:
                gone = old.live(f"{name}_lens").join(dead, "path", "left_semi").agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
                n, total = m["totals"][name][0] - gone[0] + n, m["totals"][name][1] - gone[1] + total
            totals[name] = [n, total]
        if m:
            new.bury("dead_paths", dead, small)
            new.bury("dead_calls", replaced)
        stats |= {"symbols_extracted": symbols.count(), "call_edges_resolved": edges.where("callee_id IS NOT NULL").count()}
        status.unpersist()
        scratch.remove(self.spark, scratch_at)
        merged = new.merge("files", uuid.uuid4().hex)
        self._publish(repo, {"version": merged.version if merged else version, "repo": repo, "state": (merged or new).state, "kept": sorted(old.versions()), "totals": totals, "centres": held, **extra})
        return stats

    def _search(self, repo: str, name: str, query: str, limit: int, where: Column | None = None) -> DataFrame:
        """key, score. One term's hits are found by the directory of its postings, a phrase's by counting where its terms meet."""
        terms, lens, totals = self.table(repo, f"{name}_terms"), self.table(repo, f"{name}_lens"), self._manifest(repo)["totals"][name]
        words = scalars.tokens(query)
        if len(words) != 1 or not totals[0]:
            return postings.search(terms, lens, query, limit, *totals, where)
        met = terms.where(F.col("term") == words[0]).select("key").distinct().count() if any(self._segments(repo).rows("dead_paths")) else None
        return ranked.search(terms, lens, self.table(repo, f"{name}_chunks"), query, limit, *totals, met, where)[0]

    # 3, 4: repositories.

    def list_repos(self) -> list[dict]:
        fs, at = self._fs(self.home)
        out = []
        for s in fs.listStatus(at) if fs.exists(at) else []:
            if held := self._manifests(s.getPath().toString()):
                repo = json.loads(self.spark.read.text(held[-1], wholetext=True).first()[0])["repo"]
                out.append({"repo": repo, **{r["metric"]: r["n"] for r in lookup.repo_stats(self.files(repo), self.symbols(repo), self.edges(repo)).where("key = ''").collect()}})
        return out

    def stats(self, repo: str) -> DataFrame:
        return lookup.repo_stats(self.files(repo), self.symbols(repo), self.edges(repo))

    def invalidate_cache(self, repo: str) -> dict:
        """A new version with empty tables."""
        m, held, version = self._manifest(repo), self._segments(repo), uuid.uuid4().hex
        empty = Segments(self.spark, held.base, None, version)
        for name, table in held.state["tables"].items():
            empty.add(name, held.read(name).limit(0).drop("gen"), table["order"])
        empty.state["gen"] = held.gen + 1
        self._publish(repo, m | {"version": version, "state": empty.state, "kept": sorted(held.versions()), "sha": "", "totals": {"text": [0, 0], "names": [0, 0]}})
        return {"status": "cleared", "repo": repo}

    # 5-9: lookups.

    def file_tree(self, repo: str, prefix: str = "", depth: int = 3) -> DataFrame:
        return lookup.file_tree(self.files(repo), self.symbols(repo), prefix, depth).orderBy("path")

    def tree(self, repo: str, prefix: str = "", depth: int = 3) -> dict:
        """The files of `file_tree` as nested maps, and how many files there are below the prefix at any depth."""
        out: dict = {}
        for r in self.file_tree(repo, prefix, depth).collect():
            *folders, name = r["path"].split("/")
            node = out
            for f in folders:
                node = node.setdefault(f, {})
            node[name] = {"language": r["language"], "size": r["size_bytes"], "symbols": r["symbols"]}
        return {"tree": out, "total_files": lookup.below(self.files(repo), prefix).count(), "repo": repo}

    def file_outline(self, repo: str, path: str) -> DataFrame:
        return lookup.file_outline(self.symbols(repo), path)

    def repo_outline(self, repo: str, kind: str | None = None, limit: int = 200) -> DataFrame:
        return lookup.repo_outline(self.symbols(repo), kind, limit)

    def get_symbol(self, repo: str, name: str) -> dict:
        row = self.get_symbols(repo, [name]).first()
        if row["error"]:
            raise NotFound(row["error"])
        return row.asDict()

    def get_symbols(self, repo: str, names: list[str]) -> DataFrame:
        one = lookup.first_by_name(self.symbols(repo).drop("embedding", "calls"), names)
        content = self.files(repo).select("path", "content")
        return one.join(content, "path", "left").withColumn("source", scalars.byte_slice(F.col("content"), F.col("byte_offset"), F.col("byte_length"))).drop("content").orderBy("pos")

    # 10, 11: search.

    def search_symbols(self, repo: str, query: str, kind: str | None = None, limit: int = 20) -> DataFrame:
        """qualified_name, kind, score, search_type: phrase search fused with nearest embeddings where there are any."""
        limit = K.clamp(1, limit, K.MAX_HITS)
        s = self.symbols(repo)
        top = self._search(repo, "names", query, 2 * limit)
        text = s.join(top.withColumnRenamed("key", "id"), "id")
        arms = [search.ranked(text, F.desc("score"), "id").select("qualified_name", "kind", "pos")]
        asked = self._asked(repo, query)
        if asked is not None:
            near, _ = clusters.nearest(self.table(repo, "vectors"), self._manifest(repo)["centres"], asked, "id", "embedding", 2 * limit)
            near = near.select("id", "distance").join(s.select("id", "qualified_name", "kind"), "id")
            arms.append(search.ranked(near, "distance", "id").select("qualified_name", "kind", "pos"))
        fused = search.fuse(arms, "qualified_name", limit, kind).withColumn("search_type", F.lit("hybrid" if len(arms) > 1 else "fts_only"))
        shown = s.groupBy("qualified_name").agg(F.min_by(F.struct(F.col("path").alias("file"), "line", "signature", F.substring("docstring", 1, 100).alias("docstring")), F.struct("path", "line")).alias("s"))
        return fused.join(shown, "qualified_name").select("qualified_name", "kind", "s.*", "score", "search_type").orderBy(F.desc("score"), "qualified_name")

    def _asked(self, repo: str, query: str) -> Sequence[float] | None:
        """A query's vector by what made the index's vectors; None where there are none, or no word in the query."""
        held = self._segments(repo)
        if not any(held.rows("vectors")):
            return None
        if any(held.rows("model")):
            return embedding.ask(self.spark, query, held.live("model"))
        return self.embedder([query])[0] if self.embedder else None

    def search_text(self, repo: str, query: str, glob: str | None = None, limit: int = 20) -> DataFrame:
        """path, snippet, score. Only the terms of the query, and the texts of the hits that are shown, are read."""
        where = F.col("key").rlike(glob_regex(glob)) if glob else None
        top = self._search(repo, "text", query, K.clamp(1, limit, K.MAX_HITS), where)
        text = self.files(repo).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
        return top.withColumnRenamed("key", "path").join(text, "path").select("path", search.snippet(F.col("content"), query).alias("snippet"), "score").orderBy(F.desc("score"), "path")

    # 12, 13, 15: graph.

    def get_callees(self, repo: str, name: str, depth: int = 1, depth_first: bool = False) -> DataFrame:
        """caller, callee (as written), callee_id, resolved_name, kind, def_line, def_file, line, depth; by levels, or as a depth-first walk meets them, then with its place in the walk."""
        e = self.edges(repo).select("caller", "callee", "callee_id", "resolved_name", F.col("callee_kind").alias("kind"), "def_file", "line")
        met = graph.callees_depth_first(e, None, name, depth) if depth_first else graph.callees(e, None, name, depth)
        ids = met.select(F.col("callee_id").alias("id")).distinct()
        lines = self.symbols(repo).join(ids, "id", "left_semi").select(F.col("id").alias("callee_id"), F.col("line").alias("def_line"))
        return met.join(lines, "callee_id", "left").select("caller", "callee", "callee_id", "resolved_name", "kind", "def_line", "def_file", "line", "depth", *(["place"] if depth_first else []))

    def get_callers(self, repo: str, name: str, depth: int = 1) -> DataFrame:
        """caller, kind, caller_line, caller_file (where it is defined), callee, line, depth."""
        e = self.edges(repo).select("caller", F.col("caller_kind").alias("kind"), "caller_line", F.col("path").alias("caller_file"), "callee", "line")
        return graph.callers(e, name, depth)

    def dependency_map(self, repo: str, path: str) -> DataFrame:
        e = self.edges(repo).where("callee_id IS NOT NULL").select(F.col("path").alias("caller_file"), F.col("def_file").alias("callee_file"), "caller", F.col("resolved_name").alias("callee"), F.struct("path", "line", "pos").alias("pos"))
        return graph.dependency_map(e.where((F.col("caller_file") == path) | (F.col("callee_file") == path))).where(F.col("file") == path).orderBy("direction", "other")

    def dependencies(self, repo: str, path: str) -> dict:
        """A file's dependency map with its counts."""
        n = self.symbols(repo).where(F.col("path") == path).count()
        if not n:
            raise NotFound(f"File not found in index: {path}")
        rows = self.dependency_map(repo, path).collect()
        ways = {way: {r["other"]: r["names"] for r in rows if r["direction"] == way} for way in ("depends_on", "depended_by")}
        return {"file": path, "symbols_count": n, **ways, **{f"{way}_files": len(x) for way, x in ways.items()}}

    # 14: differences.

    def diff_symbols(self, repo: str, path: str | None = None) -> DataFrame:
        """Symbols added, removed or modified in the folder since it was indexed, with kind and file; nothing is written."""
        return self._diff(repo, path)[0]

    def diff_summary(self, repo: str, path: str | None = None) -> dict:
        """Counts of `diff_symbols` and of files."""
        diff, status = self._diff(repo, path)
        kinds = diff.agg(*[F.count_if(F.col("status") == s).alias(f"{s}_count") for s in ("added", "removed", "modified")]).first().asDict()
        of = lambda *s: F.count_if(F.col("status").isin(*s))
        return kinds | status.agg(of("new", "changed").alias("changed_files"), of("new").alias("new_files"), of("deleted").alias("deleted_files")).first().asDict()

    def _diff(self, repo: str, path: str | None) -> tuple[DataFrame, DataFrame]:
        now = files.scan_directory(self.spark, files.validate_path(path or repo))
        old_files, old = self.files(repo), self.symbols(repo)
        unread = now.where("content IS NULL").select("path")
        now = now.where("content IS NOT NULL").select("path", "sha256", "language", "content")
        status = snapshot.file_status(old_files.join(unread, "path", "left_anti"), now)
        fresh = extract.extract_symbols(now.join(status.where("status IN ('new', 'changed')"), "path", "left_semi"))
        same = old.join(status.where("status = 'unchanged'").select("path").unionByName(unread), "path", "left_semi")
        columns = ["qualified_name", "line", "signature", "path", "kind", F.col("path").alias("file")]
        return snapshot.diff_symbols(old.select(*columns), same.select(*columns).unionByName(fresh.select(*columns)), ["kind", "file"]).orderBy("qualified_name"), status

    # Answers as text.

    def answer(self, tool: str, **arguments) -> str:
        """A tool's result as JSON: rows with their count, or what the tool returns; errors as {"error": ...}."""
        try:
            out = getattr(self, tool)(**arguments)
            if isinstance(out, DataFrame):
                rows = [r.asDict(recursive=True) for r in out.collect()]
                out = {"results": rows, "count": len(rows)}
            return json.dumps(out, default=str)
        except (LookupError, ValueError, OSError) as e:
            return json.dumps({"error": str(e)})


def _embed(text, embedder: Embedder):
    @F.pandas_udf("array<float>")
    def run(batch: pd.Series) -> pd.Series:
        return pd.Series(embedder(batch.fillna("").tolist()))

    return run(text)
