"""Scalar functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .patterns import ignore_regex


def language_of_path(path: Column) -> Column:
    """Language of a path's last suffix; null for unknown ones. A leading dot begins no suffix."""
    suffix = F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))
    table = F.create_map(*[F.lit(x) for e, lang in K.LANGUAGE_OF_SUFFIX.items() for x in (e, lang)])
    return F.element_at(table, suffix)


def byte_slice(content: Column, offset: Column, length: Column) -> Column:
    """Text of a byte range; malformed bytes become U+FFFD."""
    return F.make_valid_utf8(F.substring(content.cast("binary"), offset.cast("int") + 1, length.cast("int")).cast("string"))


def last_segment(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def repo_id(path: Column) -> Column:
    return F.substring(F.sha2(path, 256), 1, 12)


def cache_name(owner: Column, repo: Column) -> Column:
    return F.regexp_replace(F.concat_ws("_", owner, repo), "[^a-zA-Z0-9_-]", "_")


def embed_text(language: Column, kind: Column, name: Column, signature: Column, docstring: Column) -> Column:
    """What is embedded for a symbol; empty parts are left out."""
    some = lambda c: F.nullif(c, F.lit(""))
    return F.concat_ws(" | ", some(language), F.concat(kind, F.lit(": "), name), some(signature), some(F.substring(docstring, 1, 200)))


def secret_warnings(text: Column) -> Column:
    """Array naming the patterns that a text matches; never the value."""
    hits = [F.when(text.rlike(p if flags == "" else f"(?i){p}"), F.lit(f"Potential secret found matching pattern: {p[:40]}...")) for p, flags in K.SECRET_PATTERNS]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def parse_repo_url(url: Column) -> Column:
    """struct(host, owner, repo, url_type), or null where the address can't be parsed.

    On github.com the path begins with owner and repository; on gitlab.com the owner may be a path, and the last part that can
    name a repository does; elsewhere the repository is what the address ends with. Names have no dot, but for a final .git.
    """
    url = F.regexp_replace(url, r"^\s+|\s+$", "")
    no_git = lambda c: F.when(c.endswith(".git"), F.substring(c, F.lit(1), F.length(c) - 4)).otherwise(c)
    is_name = lambda c: (no_git(c) != "") & ~no_git(c).rlike(r"[.\s]")
    found = lambda host, owner, repo, kind: F.struct(host.alias("host"), owner.alias("owner"), repo.alias("repo"), F.lit(kind).alias("url_type"))
    parts = F.split(F.regexp_replace(url, "^https?://", ""), "/")
    host, path = F.get(parts, F.lit(0)), F.slice(parts, 2, F.size(parts))
    at = lambda k: F.get(path, k)
    first_two = F.when((host == "github.com") & (at(F.lit(0)) != "") & is_name(at(F.lit(1))), found(host, at(F.lit(0)), no_git(at(F.lit(1))), K.REPO_HOSTS["github.com"]))
    gap = F.array_position(path, "")
    named = F.filter(F.sequence(F.lit(0), F.size(path)), lambda k: (k > 0) & is_name(at(k)) & ((gap == 0) | (k < gap)))
    last = F.array_max(named)
    any_depth = F.when((host == "gitlab.com") & last.isNotNull(), found(host, F.array_join(F.slice(path, F.lit(1), last), "/"), no_git(at(last)), K.REPO_HOSTS["gitlab.com"]))

    def anywhere(text: Column) -> Column:
        host, rest = F.split_part(text, F.lit("/"), F.lit(1)), F.substring(text, F.locate("/", text) + 1, F.length(text))
        end = lambda c: F.nullif(F.element_at(F.split(c, r"[/.\s]"), -1), F.lit(""))
        repo = F.coalesce(end(no_git(rest)), end(rest))
        return F.when(text.contains("/") & (host != "") & repo.isNotNull(), found(host, F.lit(""), repo, "generic"))

    return F.coalesce(first_two, any_depth, anywhere(F.regexp_replace(url, "^https?://", "")), anywhere(url))


def json_list(items: Column) -> Column:
    """A list as JSON text; null where it is null or empty."""
    return F.when(F.size(items) > 0, F.to_json(items))


def is_binary(path: Column, content: Column) -> Column:
    """By suffix, by magic bytes, or by a NUL in the first 16 bytes. Empty files are text, unreadable (null) ones binary."""
    head = F.substring(content, 1, 16)
    suffix = F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))
    magic = F.lit(False)
    for m in K.BINARY_MAGIC:
        magic |= F.hex(head).startswith(m.hex().upper())
    nul = F.hex(head).rlike("^(?:..)*00")
    return F.coalesce(suffix.isin(*K.BINARY_SUFFIXES) | magic | nul, F.lit(True))


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether the last gitignore pattern that matches a relative path ignores it."""
    out = F.lit(False)
    for p in patterns:
        rule = ignore_regex(p)
        if rule:
            out = F.when(path.rlike(rule[0]), F.lit(not rule[1])).otherwise(out)
    return out


def hidden_directory(path: Column) -> Column:
    return path.rlike(r"(?:^|/)\.[^/]+/")


def has_prefix(path: Column, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out |= path.startswith(p.rstrip("/"))
    return out


def _folds() -> tuple[str, str]:
    """Latin letters with marks, in lower case, and their base letters."""
    pairs = [(c, unicodedata.normalize("NFD", c)[0]) for c in map(chr, range(0xC0, 0x250)) if c == c.lower() and c.isalpha()]
    pairs = [(c, b) for c, b in pairs if b != c]
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


FOLDS = _folds()


def folded(text: Column) -> Column:
    """Lower-case text without marks; empty for null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(F.octet_length(low) == F.length(low), low).otherwise(F.translate(low, *FOLDS))  # ASCII needs no folding


def normal_text(text: Column) -> Column:
    """Lower-case tokens (letters and digits, without marks), with one blank around each."""
    return F.regexp_replace(F.concat(F.lit(" "), folded(text), F.lit(" ")), r"[^\p{L}\p{N}]+", " ")


def token_count(text: Column) -> Column:
    """How many tokens `normal_text` has. Folding turns letters into letters, so it needs none."""
    return F.regexp_count(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+")).cast("long")


def tokens(text: str) -> list[str]:
    """The tokens of a query, on the driver."""
    marks = str.maketrans(*FOLDS)
    return [t for t in re.split(r"[\W_]+", text.lower().translate(marks)) if t]
