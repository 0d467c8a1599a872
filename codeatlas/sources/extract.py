"""Symbols and calls of source files: the standard parser for Python, a lexical scanner for the other languages.

The scanner blanks strings and comments, finds declarations by pattern, and bodies by braces (or `end` in Ruby). It
approximates a syntax tree: declarations within unusual macros or templates may be missed.

Offsets count bytes of the file as it is. A byte that is not UTF-8 stands as one placeholder while a file is scanned, and
as U+FFFD in what is returned. Work is linear in a file's length, but for the depth to which declarations are nested.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = (
    "path string, language string, name string, qualified_name string, kind string, signature string, docstring string, decorators array<string>, "
    "parent_name string, line int, end_line int, byte_offset long, byte_length long, calls array<struct<callee_name: string, line: int>>"
)


@dataclass
class Symbol:
    name: str
    kind: str
    start: int
    end: int
    line: int
    end_line: int
    signature: str = ""
    docstring: str = ""
    decorators: list[str] = field(default_factory=list)
    parent: str = ""
    calls: list[tuple[str, int]] = field(default_factory=list)

    @property
    def qualified(self) -> str:
        return f"{self.parent}.{self.name}" if self.parent else self.name


#: What stands for a malformed byte during a scan: one byte, so that offsets hold.
BAD = "\x1a"
_ESCAPED = re.compile("[\udc80-\udcff]")


def decoded(content: bytes) -> str:
    """The text of a file, of as many bytes as the file."""
    try:
        return content.decode()
    except UnicodeDecodeError:
        return _ESCAPED.sub(BAD, content.decode("utf-8", "surrogateescape"))


class Places:
    """Byte offset and line of a character of a text."""

    def __init__(self, source: str):
        self.lines = [m.start() for m in re.finditer("\n", source)]
        self.bytes = None
        if not source.isascii():
            c = np.frombuffer(source.encode("utf-32-le"), "<u4")
            self.bytes = np.concatenate([[0], np.cumsum(1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF))])

    def byte(self, at: int) -> int:
        return at if self.bytes is None else int(self.bytes[at])

    def line(self, at: int) -> int:
        """1-based."""
        return bisect_left(self.lines, at) + 1


def python_symbols(source: str) -> list[Symbol]:
    """By the standard parser; raises SyntaxError."""
    tree = ast.parse(source.removeprefix("\ufeff"))
    data = source.encode()
    # The parser ends lines at \r, too; a byte order mark is no part of its first line.
    starts = [3 if source.startswith("\ufeff") else 0, *(m.end() for m in re.finditer(rb"\r\n|\r|\n", data))]
    ends = [m.start() for m in re.finditer(rb"\n", data)]
    line = lambda at: bisect_left(ends, at) + 1
    begin_of = lambda n: starts[n.lineno - 1] + n.col_offset
    end_of = lambda n: starts[n.end_lineno - 1] + n.end_col_offset
    text = lambda n: data[begin_of(n) : end_of(n)].decode()
    out: list[Symbol] = []

    def calls_in(body: list[ast.AST]) -> list[tuple[str, int]]:
        found, todo = [], list(reversed(body))
        while todo:
            n = todo.pop()
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                todo.extend(reversed(n.decorator_list))
                continue
            if isinstance(n, ast.Call):
                found.append((text(n.func), line(begin_of(n))))
            todo.extend(reversed(list(ast.iter_child_nodes(n))))
        return found

    def visit(node: ast.AST, parent: str) -> None:
        for n in ast.iter_child_nodes(node):
            if not isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                visit(n, parent)
                continue
            begin, stop = begin_of(n), end_of(n)
            if isinstance(n, ast.ClassDef):
                kind = "class"
                bases = ", ".join(map(text, [*n.bases, *(k.value for k in n.keywords)]))
                sign = f"{n.name} ({bases})" if bases else n.name
            else:
                kind = "function"
                head = data[begin : begin_of(n.body[0])].decode()
                sign = f"{n.name} {_parameters(head)}" + (f" -> {text(n.returns)}" if n.returns else "")
            doc = ""
            if n.body and isinstance(n.body[0], ast.Expr) and isinstance(n.body[0].value, ast.Constant) and isinstance(n.body[0].value.value, str):
                doc = text(n.body[0].value)
                for q in ('"""', "'''"):
                    if len(doc) >= 6 and doc.startswith(q) and doc.endswith(q):
                        doc = doc[3:-3]
                        break
            s = Symbol(n.name, kind, begin, stop, line(begin), line(stop), sign, doc.strip(), [f"@{text(d)}" for d in reversed(n.decorator_list)], parent, calls_in(n.body))
            out.append(s)
            visit(n, s.qualified)

    visit(tree, "")
    return out


def _parameters(head: str) -> str:
    """The parameter list that follows a def's name, with its brackets."""
    at = head.find("(")
    depth, quote = 0, ""
    for i in range(max(at, 0), len(head)):
        c = head[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if not depth:
                return head[at : i + 1]
    return ""


@dataclass(frozen=True)
class Lexicon:
    """How a language's declarations look: (pattern, kind), the name being the group `n`."""

    rules: tuple[tuple[str, str], ...]
    comment: str = r"//[^\n]*|/\*.*?\*/"
    text: str = r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
    ends: bool = False


_NAME = r"(?P<n>[A-Za-z_$][\w$]*)"
#: Decorators on the line of what they decorate; the group `d` is no part of it.
_MARKS = r"(?P<d>(?:@[\w$.]+(?:\([^()]*(?:\([^()]*\)[^()]*)*\))?\s+)*)"
_JS = (
    (rf"\bfunction\s*\*?\s*{_NAME}\s*\(", "function"), (rf"\bclass\s+{_NAME}", "class"),
    (rf"(?:^|[;{{}}\n])\s*{_MARKS}(?:static\s+|async\s+|get\s+|set\s+|\*\s*)*(?!if\b|for\b|while\b|switch\b|catch\b|function\b|return\b|else\b){_NAME}\s*\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^={{;]+)?\{{", "method"),
    # An arrow function has a name only in its one bare parameter.
    (rf"(?<![\w$.]){_NAME}\s*=>", "function"),
)
_C = ((rf"(?:^|[;}}\n])[ \t]*(?:[A-Za-z_][\w:<>,*& \t]*[ \t*&])(?P<n>[A-Za-z_~][\w:~]*)\s*\([^;{{}}()]*(?:\([^()]*\)[^;{{}}()]*)*\)\s*(?:const\s*|noexcept\s*|override\s*)*\{{", "function"), (rf"\bstruct\s+{_NAME}\s*(?::[^{{;]+)?\{{", "struct"), (r"\btypedef\b[^;{]*?\b(?P<n>\w+)\s*;", "type"))
LEXICONS = {
    "javascript": Lexicon(_JS, text=r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`"),
    "typescript": Lexicon((*_JS, (rf"\binterface\s+{_NAME}", "interface"), (rf"\btype\s+{_NAME}\s*(?:<[^=]*>)?=", "type")), text=r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`"),
    "go": Lexicon(((rf"\bfunc\s+{_NAME}\s*(?:\[[^\]]*\])?\(", "function"), (rf"\bfunc\s*\([^)]*\)\s*{_NAME}\s*\(", "method"), (rf"\btype\s+{_NAME}\s+", "type")), text=r"\"(?:\\.|[^\"\\\n])*\"|`[^`]*`|'(?:\\.|[^'\\\n])+'"),
    "rust": Lexicon(((rf"\bfn\s+{_NAME}\s*[<(]", "function"), (rf"\bstruct\s+{_NAME}", "struct"), (rf"\benum\s+{_NAME}", "enum"), (rf"\btrait\s+{_NAME}", "interface"), (rf"\btype\s+{_NAME}\s*(?:<[^=]*>)?=", "type")), text=r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\\n])'"),
    "java": Lexicon(((rf"\b(?:public|private|protected)\s+{_NAME}\s*\([^;{{}}()]*\)\s*(?:throws[^{{;]+)?\{{", "function"), (rf"\bclass\s+{_NAME}", "class"), (rf"\benum\s+{_NAME}", "enum"), (rf"\binterface\s+{_NAME}", "interface"), (rf"(?:public|private|protected|static|final|abstract|synchronized|\s)+[\w<>\[\],.?]+\s+(?!new\b|return\b|else\b){_NAME}\s*\([^;{{}}()]*\)\s*(?:throws[^{{;]+)?\{{", "method"))),
    "c": Lexicon(_C),
    "cpp": Lexicon((*_C, (rf"\bclass\s+{_NAME}\s*(?:final\s*)?(?::[^{{;]+)?\{{", "class"), (rf"\busing\s+{_NAME}\s*=", "type"))),
    "csharp": Lexicon(((rf"\b(?:public|private|protected|internal)\s+{_NAME}\s*\([^;{{}}()]*\)\s*(?::[^{{]+)?\{{", "function"), (rf"\bclass\s+{_NAME}", "class"), (rf"\bstruct\s+{_NAME}", "struct"), (rf"\benum\s+{_NAME}", "enum"), (rf"\binterface\s+{_NAME}", "interface"), (rf"(?:public|private|protected|internal|static|virtual|override|async|sealed|\s)+[\w<>\[\],.?]+\s+(?!new\b|return\b|else\b){_NAME}\s*\([^;{{}}()]*\)\s*\{{", "method"))),
    "ruby": Lexicon(((r"\bdef\s+(?:self\.)?(?P<n>[A-Za-z_]\w*[?!=]?)", "method"), (r"^\s*class\s+(?P<n>[A-Z]\w*)", "class"), (r"^\s*module\s+(?P<n>[A-Z]\w*)", "module")), comment=r"\#[^\n]*", ends=True),
    "python": Lexicon(((rf"\bdef\s+{_NAME}\s*\(", "function"), (rf"\bclass\s+{_NAME}", "class")), comment=r"\#[^\n]*"),
}
_CALL = re.compile(r"((?:[A-Za-z_$][\w$]*(?:\.|::|->))*[A-Za-z_$][\w$]*[?!]?)\s*\(")
#: Ruby: a method after a dot, or a name followed by brackets or, at the beginning of a statement, by an argument.
_RUBY_CALL = re.compile(r"(?m)(?:\.|&\.)([A-Za-z_]\w*[?!]?)|(?<![\w.@$:])([a-z_]\w*[?!]?)\(|(?:^|;|\bthen\b|\bdo\b)[ \t]*([a-z_]\w*[?!]?)(?=[ \t]+(?:[\w@:\[$&*]|->))(?![ \t]+(?:if|unless|while|until|and|or|do|then|rescue|in)\b)")
_NOT_CALLS = frozenset("if for while switch catch return function def fn func class sizeof match elif unless and or not in new await typeof print_if using lock foreach when case else do".split())
_RUBY_WORDS = frozenset("if unless while until for case when else elsif end def class module begin rescue ensure return yield and or not in then do self super nil true false next break redo retry alias undef defined? puts_if".split())
_MODIFIERS = frozenset("export default declare public private protected internal static final abstract sealed partial async readonly override virtual synchronized strictfp unsafe new".split())


def lexical_symbols(source: str, language: str) -> list[Symbol]:
    lex = LEXICONS[language]
    # Strings and comments in one pass, so that neither begins inside the other; strings are blank, but for Ruby's arguments their first sign.
    comments: dict[int, str] = {}

    def fade(m: re.Match) -> str:
        if m["c"]:
            comments[m.end()] = m["c"]
        gone = re.sub(r"[^\n]", " ", m[0])
        return "$" + gone[1:] if lex.ends and not m["c"] else gone

    blank = re.compile(f"(?:{lex.text})|(?P<c>{lex.comment})", re.S).sub(fade, source)
    places, end_of = Places(source), _ends(blank, lex.ends)
    found: dict[int, Symbol] = {}
    spans: dict[int, tuple[int, int]] = {}
    for pattern, kind in lex.rules:
        for m in re.finditer(pattern, blank, re.M):
            begin = m.start() + len(m[0]) - len(m[0].lstrip(" \t\n;{}"))
            if "d" in m.groupdict() and m["d"]:
                begin = m.end("d")
            if m.start("n") in spans:
                continue
            end = _arrow_end(blank, m.end(), end_of) if m[0].endswith("=>") else end_of(begin if lex.ends else m.end() - 1)
            spans[m.start("n")] = (begin, end)
            par = _PARAMETERS.match(blank, m.end("n"), end)
            sign = m["n"] + (f" {source[par.start(1) : par.end(1)]}" + (f" -> {par[3].strip()}" if par[3] and (par[2] == "->" or language in ("javascript", "typescript")) else "") if par else "")
            found[m.start("n")] = Symbol(m["n"], kind, begin, end, places.line(begin), places.line(end), sign, _comment_before(source, begin, comments), _decorators(source, blank, begin, language))
    out = [found[k] for k in sorted(found, key=lambda k: (spans[k][0], -spans[k][1]))]
    stack: list[Symbol] = []
    for s in out:
        while stack and stack[-1].end < s.end:
            stack.pop()
        s.parent = stack[-1].qualified if stack else ""
        stack.append(s)
    _give_calls(out, sorted(spans), blank, language, places)
    for s in out:
        s.start, s.end = places.byte(s.start), places.byte(s.end)
    return out


_PARAMETERS = re.compile(r"\s*(\([^{};]*?\))\s*(?:(->|:)\s*([^{;\n]+))?(?=\s*[{;\n]|$)")


def _give_calls(symbols: list[Symbol], names: list[int], blank: str, language: str, places: Places) -> None:
    """Each call goes to the innermost symbol around it; calls and symbols are both met in order."""
    ruby, held, k = language == "ruby", [], 0
    for m in (_RUBY_CALL if ruby else _CALL).finditer(blank):
        group = m.lastindex if ruby else 1
        at, name = m.start(group), m[group]
        if (ruby and group > 1 and name in _RUBY_WORDS) or (not ruby and name.split(".")[-1] in _NOT_CALLS):
            continue
        near = bisect_left(names, at)
        if near < len(names) and names[near] < m.end(group):
            continue
        while k < len(symbols) and symbols[k].start <= at:
            while held and held[-1].end <= symbols[k].start:
                held.pop()
            held.append(symbols[k])
            k += 1
        while held and held[-1].end <= at:
            held.pop()
        if held:
            held[-1].calls.append((name, places.line(at)))


def _ends(blank: str, ruby: bool) -> Callable[[int], int]:
    """A function from a place to the end of the body that opens there (Ruby) or next (braces)."""
    closes: dict[int, int] = {}
    held: list[int] = []
    if ruby:
        for m in re.finditer(r"(?m)\b(?:def|class|module|do|begin|case)\b|^\s*(?:if|unless|while|until|for)\b|\bend\b", blank):
            if m[0] != "end":
                held.append(m.start())
            elif held:
                closes[held.pop()] = m.end()
        return lambda at: closes.get(at, len(blank))
    opens, semis, lines = [], [], []
    for m in re.finditer(r"[{};\n]", blank):
        if m[0] == "{":
            opens.append(m.start())
            held.append(m.start())
        elif m[0] == "}":
            if held:
                closes[held.pop()] = m.end()
        else:
            (semis if m[0] == ";" else lines).append(m.start())

    def end(at: int) -> int:
        brace, semi, line = (x[k] if (k := bisect_left(x, at)) < len(x) else -1 for x in (opens, semis, lines))
        if brace < 0 or 0 <= semi < brace:
            return semi + 1 if semi >= 0 else line if line >= 0 else len(blank)
        return closes.get(brace, len(blank))

    return end


def _arrow_end(blank: str, at: int, end_of: Callable[[int], int]) -> int:
    """The end of an arrow function's body: its braces, or the expression up to what closes or follows it."""
    while at < len(blank) and blank[at].isspace():
        at += 1
    if blank[at : at + 1] == "{":
        return end_of(at)
    depth = 0
    for m in re.compile(r"[(\[{]|[)\]}]|[,;\n]").finditer(blank, at):
        depth += (m[0] in "([{") - (m[0] in ")]}")
        if depth < 0 or depth == 0 and m[0] in ",;\n":
            return m.start()
    return len(blank)


def _decorators(source: str, blank: str, begin: int, language: str) -> list[str]:
    """Annotations or attributes right before a declaration and its modifiers, nearest first."""
    if language not in ("javascript", "typescript", "java", "csharp", "python"):
        return []
    out, i = [], begin
    pairs = {")": "(", "]": "["}
    while True:
        while i > 0 and blank[i - 1].isspace():
            i -= 1
        j = i
        if i > 0 and blank[i - 1] == ("]" if language == "csharp" else ")"):
            close, depth = blank[i - 1], 0
            while j > 0:
                j -= 1
                depth += (blank[j] == close) - (blank[j] == pairs[close])
                if not depth:
                    break
            if language == "csharp":
                if depth:
                    return out
                out.append(source[j:i])
                i = j
                continue
        p = j
        while p > 0 and (blank[p - 1].isalnum() or blank[p - 1] in "_$."):
            p -= 1
        if language != "csharp" and p < j and p > 0 and blank[p - 1] == "@":
            out.append(source[p - 1 : i])
            i = p - 1
        elif j == i and blank[p:i] in _MODIFIERS:
            i = p
        else:
            return out


def _comment_before(source: str, begin: int, comments: dict[int, str]) -> str:
    """The comment right before a declaration, without its marks."""
    while begin > 0 and source[begin - 1].isspace():
        begin -= 1
    out = comments.get(begin, "").strip()
    for marks in ("//", "/*", "*/", "*", "#"):
        out = out.strip(marks)
    return out.strip()


def extract(path: str, language: str | None, content: bytes | None) -> list[tuple]:
    """Rows of SCHEMA for one file; none for unknown languages or what can't be read."""
    if not content or language not in LEXICONS:
        return []
    source = decoded(content)
    try:
        found = python_symbols(source) if language == "python" else lexical_symbols(source, language)
    except (SyntaxError, ValueError, RecursionError):
        found = lexical_symbols(source, language)
    shown = (lambda t: t.replace(BAD, "\ufffd")) if BAD in source else lambda t: t
    return [
        (path, language, shown(s.name), shown(s.qualified), s.kind, shown(s.signature), shown(s.docstring), [shown(d) for d in s.decorators], shown(s.parent), s.line, s.end_line, s.start, s.end - s.start, [{"callee_name": shown(c), "line": n} for c, n in s.calls])
        for s in found
    ]


def extract_symbols(files: DataFrame) -> DataFrame:
    """Symbols of files (path, language, content). Filter to new and changed files before: only this runs in Python."""
    fields = ["path", "language", "name", "qualified_name", "kind", "signature", "docstring", "decorators", "parent_name", "line", "end_line", "byte_offset", "byte_length", "calls"]
    kinds = [pa.string()] * 7 + [pa.list_(pa.string()), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.struct([("callee_name", pa.string()), ("line", pa.int32())]))]

    def run(batches):
        for b in batches:
            for p, lang, c in zip(*(b.column(k).to_pylist() for k in ("path", "language", "content"))):
                if rows := extract(p, lang, c):
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=fields)

    return files.select("path", "language", F.col("content").cast("binary").alias("content")).mapInArrow(run, SCHEMA)
