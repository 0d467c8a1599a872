"""Glob, LIKE and ignore patterns as anchored regular expressions. Pure functions on the driver."""

from __future__ import annotations

import re


def glob_regex(glob: str) -> str:
    """Case-sensitive GLOB: `*` crosses `/`, `?` is one character, `[...]` a class."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            inside = glob[i + 1 : end].replace("\\", "\\\\")
            out += f"[{inside}]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^{out}$"


def like_regex(pattern: str) -> str:
    """LIKE with live `%` and `_`, case-insensitive for ASCII letters only."""
    return "(?s)^" + "".join(".*" if c == "%" else "." if c == "_" else f"[{c.lower()}{c.upper()}]" if c.isascii() and c.isalpha() else re.escape(c) for c in pattern) + "$"


def _segment(text: str) -> str:
    out, i = "", 0
    while i < len(text):
        c = text[i]
        end = text.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "\\" and i + 1 < len(text):
            i += 1
            out += re.escape(text[i])
        elif end > 0:
            inside = text[i + 1 : end]
            out += "[^" + inside[1:] + "]" if inside[0] in "!^" else f"[{inside}]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return out


def ignore_regex(pattern: str) -> tuple[str, bool] | None:
    """(regex over a relative path, negated?) of one gitignore line; None for blank lines and comments.

    A pattern that names a directory covers all below it; one with `/` only at its end is for directories.
    """
    line = pattern.rstrip("\n").rstrip()
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[1:] if negated else line.removeprefix("\\") if line[:2] in ("\\#", "\\!") else line
    only_dir = line.endswith("/")
    line = line.rstrip("/")
    if not line:
        return None
    anchored = "/" in line
    parts = line.lstrip("/").split("/")
    out = "" if anchored else "(?:.*/)?"
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        if part == "**":
            out += ".*" if last else "(?:.*/)?"
        else:
            out += _segment(part) + ("" if last else "/")
    return f"^{out}{'/.*' if only_dir else '(?:/.*)?'}$", negated


def ignored(path: str, patterns: list[str]) -> bool:
    """The last pattern that matches decides."""
    verdict = False
    for p in patterns:
        rule = ignore_regex(p)
        if rule and re.search(rule[0], path):
            verdict = not rule[1]
    return verdict
