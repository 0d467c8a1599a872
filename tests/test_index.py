import io
import json
import os
import tarfile

import pytest

from codeatlas.api import Index, NotFound
from codeatlas.operators import search
from codeatlas.sources import files
from codeatlas.sources.extract import extract

STOCK = '''"""Stock of a small warehouse."""

LIMIT = 40


def weigh(box: dict) -> float:
    """Mass of a box in kilograms."""
    return box["grams"] / 1000


class Shelf(list):
    """Boxes side by side."""

    def put(self, box):
        if weigh(box) > LIMIT:
            raise ValueError(box)
        self.append(box)

    @property
    def mass(self):
        return sum(map(weigh, self))


def audit(path):
    shelf = Shelf()
    shelf.put({"grams": 5})
    return shelf.mass
'''
BELT = "// Joins two parts.\nfunction link(a, b) { return a + b; }\nclass Belt {\n  run(x) { return link(x, x); }\n}\n"


def names(rows):
    return {r[3]: r for r in rows}


def test_python_facts():
    got = names(extract("m.py", "python", STOCK.encode()))
    assert set(got) == {"weigh", "Shelf", "Shelf.put", "Shelf.mass", "audit"}
    w = got["weigh"]
    assert w[9:11] == (6, 8) and w[5] == "weigh (box: dict) -> float" and w[6] == "Mass of a box in kilograms."
    assert got["Shelf.put"][4] == "function" and got["Shelf.put"][8] == "Shelf" and got["Shelf"][5] == "Shelf (list)"
    assert [c["callee_name"] for c in got["Shelf.put"][13]] == ["weigh", "ValueError", "self.append"]
    assert got["Shelf.mass"][7] == ["@property"]
    assert "Shelf" in {c["callee_name"] for c in got["audit"][13]}
    assert STOCK.encode()[w[11] : w[11] + w[12]].startswith(b"def weigh")


@pytest.mark.parametrize("language, content", [
    ("python", b"# \xff\xff\xff bad\ndef f(a=')'):\n    return g('\xe9')\n"), ("python", "\ufeff# é\r\n@d\r\ndef f():\r\n  pass\r\n".encode()), ("python", b"x = 1\x0c\ny = '\xc3'\rdef f(): pass\n"),
    ("javascript", b"// \xff\xfe\nvar s = '\xe2\x82';\nfunction f(a) { return '\xff'; }\n"), ("javascript", "/* é日🙂 */\r\nfunction f(a) {\r\n  return 'ü'; }\r\n".encode()),
    ("python", b"# \xff\nx = (\ndef f(a):\n    pass"),
])
def test_offsets_are_of_the_file_as_it_is(language, content):
    (row,) = [r for r in extract("f", language, content) if r[2] == "f"]
    span = content[row[11] : row[11] + row[12]]
    assert span.startswith((b"def f", b"function f")) and b"\n# " not in span
    assert row[9] == content[: row[11]].count(b"\n") + 1 and "\x1a" not in repr(row)


@pytest.mark.parametrize("language, source, want", [
    ("typescript", '@Part({a: 1})\nexport class A {\n  @On("x") run(e) { go(e); }\n  @a.b\n  static m(x) { }\n}\n', {"A": ["@Part({a: 1})"], "A.run": ['@On("x")'], "A.m": ["@a.b"]}),
    ("csharp", '[One]\n[Two("x")]\npublic class A {\n  [Get] public int M(int a) { return 1; }\n}', {"A": ['[Two("x")]', "[One]"], "A.M": ["[Get]"]}),
    ("java", "@Entity\npublic class A {\n  @Override\n  public int get() { return 1; }\n  int bare() { return 2; }\n}", {"A": ["@Entity"], "A.get": ["@Override"], "A.bare": []}),
    ("python", "def broken(\n    pass\n@x\n@y.z(1)\ndef g(): pass", {"broken": [], "g": ["@y.z(1)", "@x"]}),
    ("go", "func F() { }", {"F": []}),
])
def test_decorators(language, source, want):
    assert {k: r[7] for k, r in names(extract("f", language, source.encode())).items()} == want


def test_ruby_calls_and_arrows():
    got = names(extract("f", "ruby", b"class A\n  attr_reader :a\n  def go(x)\n    puts 'hi'\n    x.bar 1\n    baz(2) if ok\n    y = 3\n  end\nend\n"))
    assert [c["callee_name"] for c in got["A.go"][13]] == ["puts", "bar", "baz"] and [c["callee_name"] for c in got["A"][13]] == ["attr_reader"]
    got = names(extract("f", "javascript", b"const a = x => { f(x) };\nconst b = (p, q) => g(p);\nlist.map(v => h(v), 1);"))
    assert {k: [c["callee_name"] for c in r[13]] for k, r in got.items()} == {"x": ["f"], "v": ["h"]}


def test_large_files_take_linear_time():
    import time

    js = "class A {\n" + "\n".join(f"  m{i}(x) {{ return f{i}(x); }}" for i in range(20_000)) + "\n}\n"
    py = "# é\n" + "\n".join(f"def m{i}(x):\n    return f{i}(x)" for i in range(20_000))
    began = time.perf_counter()
    assert len(extract("a.js", "javascript", js.encode())) == 20_001 and len(extract("a.py", "python", py.encode())) == 20_000
    assert time.perf_counter() - began < 60


@pytest.mark.parametrize("path, language, content", [("a.py", "python", b""), ("a.json", None, b"{}"), ("a.py", "python", None)])
def test_nothing_to_extract(path, language, content):
    assert extract(path, language, content) == []


def test_broken_python_gives_a_list():
    assert isinstance(extract("b.py", "python", b"def broken(\n    pass"), list)


@pytest.mark.parametrize("language, source, want", [
    ("javascript", BELT, {"link": "function", "Belt": "class", "Belt.run": "method"}),
    ("typescript", "interface A { x: number }\ntype B = string;\nfunction f(x: number) { return g(x); }", {"A": "interface", "B": "type", "f": "function"}),
    ("go", "package m\nfunc Hello(n string) string { return x(n) }\ntype G struct { N string }\nfunc (g *G) Greet() { Hello(g.N) }", {"Hello": "function", "G": "type", "Greet": "method"}),
    ("rust", "fn add(a: i32) -> i32 { a }\nstruct Point { x: f64 }\nimpl Point { fn distance(&self) {} }\nenum E { A }", {"add": "function", "Point": "struct", "distance": "function", "E": "enum"}),
    ("java", "public class A { public A(int x) { } public int get() { return h(x); } }\ninterface I { }", {"A": "class", "A.A": "function", "A.get": "method", "I": "interface"}),
    ("c", "struct P { int x; };\nint add(int a) {\n  return foo(a);\n}\n", {"P": "struct", "add": "function"}),
    ("cpp", "class A {\n public:\n  int get() { return f(); }\n};\n", {"A": "class", "A.get": "function"}),
    ("csharp", "public class A { public int Get() { return F(1); } }\nstruct S { }", {"A": "class", "A.Get": "method", "S": "struct"}),
    ("ruby", "module M\n  class A\n    def go(x)\n      foo(x) if x\n    end\n  end\nend\n", {"M": "module", "M.A": "class", "M.A.go": "method"}),
])
def test_other_languages(language, source, want):
    assert {k: r[4] for k, r in names(extract("f", language, source.encode())).items()} == want


@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "repo"
    (root / "src").mkdir(parents=True)
    (root / "node_modules" / "x").mkdir(parents=True)
    (root / ".hidden").mkdir()
    (root / "src" / "main.py").write_text(STOCK)
    (root / "src" / "belt.js").write_text(BELT)
    (root / "src" / "__init__.py").write_text("")
    (root / "src" / "use.py").write_text("from main import weigh\n\ndef use():\n    return weigh({})\n")
    (root / "node_modules" / "x" / "i.js").write_text("function no() {}")
    (root / ".hidden" / "h.py").write_text("def no(): pass")
    (root / "skip.py").write_text("def no(): pass")
    (root / "big.py").write_text("x" * (2 * 1024 * 1024 + 1))
    (root / "bin.py").write_bytes(b"\x7fELF\0\0")
    (root / ".gitignore").write_text("skip.py\n")
    return root


def test_index_end_to_end(spark, repo, tmp_path):
    index = Index(spark, str(tmp_path / "home"), embedder=lambda texts: [[float(len(t)), float(t.count("e"))] for t in texts])
    r = str(repo)
    first = index.index_folder(r, embed=True)
    assert (first["indexed"], first["skipped_unchanged"], first["deleted"], first["errors"]) == (4, 0, 0, 0)
    assert first["call_edges_resolved"] >= 3
    assert {x["path"] for x in index.files(r).collect()} == {"src/main.py", "src/belt.js", "src/use.py", "src/__init__.py"}
    assert index.get_symbol(r, "weigh")["source"].startswith("def weigh(box")
    with pytest.raises(NotFound):
        index.get_symbol(r, "nope")
    assert [x["error"] is None for x in index.get_symbols(r, ["audit", "nope", "link"]).collect()] == [True, False, True]
    assert {(x["callee"], x["resolved_name"], x["kind"], x["def_file"], x["def_line"]) for x in index.get_callees(r, "Belt.run").collect()} == {("link", "link", "function", "src/belt.js", 2)}
    deep = index.get_callees(r, "audit", 2).collect()
    assert {(x["callee"], x["depth"]) for x in deep} >= {("Shelf", 1), ("shelf.put", 1)}
    assert {(x["caller"], x["kind"], x["caller_file"], x["caller_line"]) for x in index.get_callers(r, "weigh").collect()} == {("Shelf.put", "function", "src/main.py", 14), ("use", "function", "src/use.py", 3)}
    assert {(x["caller"], x["depth"]) for x in index.get_callers(r, "weigh", 2).collect()} == {("Shelf.put", 1), ("use", 1), ("audit", 2)}
    assert {(x["direction"], x["other"]) for x in index.dependency_map(r, "src/main.py").collect()} == {("depended_by", "src/use.py")}
    assert index.dependencies(r, "src/main.py") == {"file": "src/main.py", "symbols_count": 5, "depends_on": {}, "depended_by": {"src/use.py": ["use"]}, "depends_on_files": 0, "depended_by_files": 1}
    assert index.search_symbols(r, "Mass of").first()["qualified_name"] == "weigh"
    assert index.search_symbols(r, "Mass of").first()["search_type"] == "hybrid"
    assert [x["path"] for x in index.search_text(r, "return link", "*.js").collect()] == ["src/belt.js"]
    scanned = search.search_text(spark.createDataFrame([(x["path"], bytes(x["content"]).decode()) for x in index.files(r).collect()], "path string, content string"), "return")
    assert index.search_text(r, "return").collect() == scanned.collect() and scanned.count() == 3
    assert [x["qualified_name"] for x in index.file_outline(r, "src/belt.js").collect()] == ["link", "Belt", "Belt.run"]
    assert {x["qualified_name"] for x in index.repo_outline(r, "class").collect()} == {"Shelf", "Belt"}
    tree = index.tree(r, "src")
    assert tree["total_files"] == 4 and tree["tree"]["src"]["main.py"]["symbols"] == 5
    assert json.loads(index.answer("get_symbol", repo=r, name="nope")) == {"error": "Symbol not found: nope"}
    assert json.loads(index.answer("get_callers", repo=r, name="link"))["count"] == 1
    stamps = {x["path"]: x["indexed_at"] for x in index.files(r).collect()}
    (repo / "src" / "main.py").write_text(STOCK.replace("def audit(path):", "def extra():\n    pass\n\n\ndef audit(a):"))
    (repo / "src" / "use.py").unlink()
    diff = {x["qualified_name"]: (x["status"], x["kind"], x["file"]) for x in index.diff_symbols(r).collect()}
    assert diff == {"extra": ("added", "function", "src/main.py"), "audit": ("modified", "function", "src/main.py"), "use": ("removed", "function", "src/use.py")}
    assert index.diff_summary(r) == {"added_count": 1, "removed_count": 1, "modified_count": 1, "changed_files": 1, "new_files": 0, "deleted_files": 1}
    again = index.index_folder(r, exclude=["*.js"])
    assert (again["indexed"], again["skipped_unchanged"], again["deleted"]) == (1, 1, 2)
    now = {x["path"]: x["indexed_at"] for x in index.files(r).collect()}
    assert now["src/__init__.py"] == stamps["src/__init__.py"] and now["src/main.py"] > stamps["src/main.py"]
    assert [x["path"] for x in index.search_text(r, "def extra").collect()] == ["src/main.py"] and index.search_text(r, "return link").count() == 0
    assert index.list_repos()[0]["files"] == 2
    index.invalidate_cache(r)
    assert index.files(r).count() == 0 and index.search_text(r, "return").count() == 0
    folder = tmp_path / "home" / index._id(r)
    assert len([x for x in os.listdir(folder) if not x.startswith((".", "manifest"))]) == 2


def test_unreadable_files_are_errors_and_stay(spark, repo, tmp_path):
    index, r = Index(spark, str(tmp_path / "home")), str(repo)
    index.index_folder(r)
    gone = repo / "src" / "use.py"
    gone.unlink()
    gone.symlink_to(gone)  # listed, but can't be opened
    kept = [(p, None if p == "src/use.py" else s, lang, n, None if p == "src/use.py" else c) for p, s, lang, n, c in index.files(r).select("path", "sha256", "language", "size_bytes", "content").collect()]
    scanned = spark.createDataFrame(kept, "path string, sha256 string, language string, size_bytes long, content binary")
    out = index._update(r, scanned, False, {})
    assert (out["errors"], out["deleted"], out["skipped_unchanged"]) == (1, 0, 4)
    assert index.get_symbol(r, "use")["source"].startswith("def use")


def test_archive(spark, tmp_path):
    path = str(tmp_path / "a.tar.gz")
    with tarfile.open(path, "w:gz") as t:
        for name, body in {"top-1/src/a.py": "def a(): pass", "top-1/src2/b.py": "def b(): a()", "top-1/lib/c.py": "x = 1", "top-1/../../etc/evil.py": "def e(): pass"}.items():
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body.encode()))
    assert {r["path"] for r in files.scan_archive(spark, path, ["src/"]).collect()} == {"src/a.py", "src2/b.py"}
    index = Index(spark, str(tmp_path / "home"))
    assert index.index_repo("https://github.com/o/r.git", path, sha="1")["indexed"] == 3
    assert index.index_repo("https://github.com/o/r.git", path, sha="1")["cached"]
    with pytest.raises(ValueError, match="Cannot parse"):
        index.index_repo("nothing", path)


def test_validate_path(tmp_path):
    (tmp_path / "base").mkdir()
    (tmp_path / "base2").mkdir()
    assert files.validate_path(str(tmp_path / "base"), str(tmp_path))
    for bad in ("base2", "base/../base2", "missing"):
        with pytest.raises(ValueError):
            files.validate_path(str(tmp_path / bad), str(tmp_path / "base"))


def test_stream(spark, tmp_path):
    from codeatlas.streaming import ingest

    schema = "path string, sha256 string, modificationTime timestamp"
    src, table = str(tmp_path / "in"), str(tmp_path / "t")
    for k, rows in enumerate(([("a", "1"), ("a", "2"), ("b", "1")], [("a", "3")])):
        spark.createDataFrame([(p, h, None) for p, h in rows], schema).coalesce(1).write.mode("append").parquet(src)
        q = ingest.upsert_stream(spark.readStream.schema(schema).parquet(src), table).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
        q.awaitTermination()
    assert {(r["path"], r["sha256"]) for r in spark.read.parquet(f"{table}/v1").collect()} == {("a", "3"), ("b", "1")}
