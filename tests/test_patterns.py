import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
import re

from codeatlas.functions import patterns


@settings(max_examples=200, deadline=None)
@given(st.text("ab_%.EÉé", max_size=6), st.text("abA_%.eEÉé", max_size=8))
def test_like_is_sqlites(pattern, text):
    want = sqlite3.connect(":memory:").execute("SELECT ? LIKE ?", (text, pattern)).fetchone()[0]
    assert bool(re.search(patterns.like_regex(pattern), text)) == bool(want)


@settings(max_examples=200, deadline=None)
@given(st.text("ab*?/.", max_size=6), st.text("abA/.", max_size=8))
def test_glob_is_sqlites(pattern, text):
    want = sqlite3.connect(":memory:").execute("SELECT ? GLOB ?", (text, pattern)).fetchone()[0]
    assert bool(re.search(patterns.glob_regex(pattern), text)) == bool(want)


@pytest.mark.parametrize("path, lines, want", [
    ("node_modules/a/b.js", ["node_modules"], True), ("src/node_modules/x.js", ["node_modules"], True), ("a.egg-info/x.py", ["*.egg-info"], True),
    ("src/a.py", ["/src"], True), ("lib/src/a.py", ["/src"], False), ("build", ["build/"], False), ("build/x.py", ["build/"], True),
    ("a/b/c.py", ["a/**/c.py"], True), ("a/c.py", ["a/**/c.py"], True), ("keep.js", ["*.js", "!keep.js"], False), ("x.js", ["*.js", "!keep.js"], True),
    ("x.py", ["# x.py", ""], False), ("docs/a/x.py", ["docs/*.py"], False), ("#a.py", ["\\#a.py"], True),
])
def test_ignore(path, lines, want):
    assert patterns.ignored(path, lines) == want
