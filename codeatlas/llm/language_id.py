"""Language identification by rank-order n-gram profiles and out-of-place distance.

N-grams of 1 to 3 letters are taken within words (runs of letters, lower case, one blank at each end). A null text, or
one without a letter, is `und` with score 0. Rows are judged each by themselves; repeated rows count each time in
training; a null doc_id never trains and is not held out; extra columns are not
read; an empty table gives an empty result, and without training rows all are `und`.
"""

from __future__ import annotations

import re
import sys
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHIFT = np.uint64(21)


NOT_LETTERS = re.compile(r"[\W\d_]+")


@cache
def numerals() -> tuple[frozenset[str], dict[int, str]]:
    """What `\\w` takes though it is neither letter nor decimal digit, such as superscripts and Roman numerals, and its change into blanks."""
    found = frozenset(c for c in map(chr, range(128, sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
    return found, dict.fromkeys(map(ord, found), " ")


def letters_only(text: str) -> str:
    """Lower case, each run without a letter one blank, one at each end."""
    text = text.lower()
    if not text.isascii():
        found, blanks = numerals()
        if not found.isdisjoint(text):
            text = text.translate(blanks)
    return " " + NOT_LETTERS.sub(" ", text).strip() + " "


def gram_counts(text: str, step: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of a whole text, coded from code points, ascending, with their counts. Long texts are counted in pieces cut at words."""
    text = letters_only(text)
    if len(text) <= 2:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, counts, at = [], [], 0
    while at < len(text) - 1:
        end = len(text) if len(text) - at <= step else text.find(" ", at + step) + 1 or len(text)
        c = np.frombuffer(text[at:end].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        two = (c[:-1] << SHIFT) | c[1:]
        three = (two[:-1] << SHIFT) | c[2:]
        blank = np.uint64(32)
        out, n = np.unique(np.concatenate([c[c != blank], two, three[c[1:-1] != blank]]), return_counts=True)
        keys.append(out)
        counts.append(n)
        at = end - 1
    if len(keys) == 1:
        return keys[0], counts[0]
    out, back = np.unique(np.concatenate(keys), return_inverse=True)
    return out, np.bincount(back, np.concatenate(counts)).astype(np.int64)


def code_of(gram: str) -> int:
    """How an n-gram is coded."""
    out = 0
    for c in gram:
        out = out << int(SHIFT) | ord(c)
    return out


def train(docs: DataFrame, size: int = 400) -> dict[str, np.ndarray]:
    """The `size` most frequent n-grams of each language, most frequent first. Counts cover all rows of `docs` (text, lang)."""

    def count(batches):
        for b in batches:
            held: dict[str, list] = {}
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                if lang is not None and text:
                    held.setdefault(lang, []).append(gram_counts(text))
            for lang, parts in held.items():
                out, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                n = np.bincount(back, np.concatenate([c for _, c in parts]), len(out)).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(out), "gram": out.astype(np.int64), "n": n}, schema)

    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])
    total = docs.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = total.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= size)
    out: dict[str, list] = {}
    for r in ranked.orderBy("lang", "rank").collect():  # languages x size rows
        out.setdefault(r["lang"], []).append(r["gram"])
    return {k: np.array(v, np.uint64) for k, v in out.items()}


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], size: int = 400) -> DataFrame:
    """doc_id, lang_pred, score (1: ranks agree in full, 0: nothing in common). Only text is looked at."""
    langs = sorted(profiles)
    grams = np.unique(np.concatenate([np.zeros(0, np.uint64), *profiles.values()]))
    ranks = np.full((len(langs), len(grams) + 1), -1, np.int64)
    for k, lang in enumerate(langs):
        ranks[k, np.searchsorted(grams, profiles[lang])] = np.arange(len(profiles[lang]))

    def place(text: str | None) -> tuple[str, float]:
        if not text or not langs:
            return "und", 0.0
        keys, n = gram_counts(text)
        if not len(keys):
            return "und", 0.0
        if len(keys) > size:
            least = np.partition(n, len(n) - size)[len(n) - size]
            keys, n = keys[n >= least], n[n >= least]
        top = keys[np.lexsort((keys, -n))][:size]
        at = np.searchsorted(grams, top)
        at = np.where((at < len(grams)) & (grams[np.minimum(at, len(grams) - 1)] == top), at, len(grams))
        theirs = ranks[:, at]
        away = np.where(theirs < 0, size, np.minimum(size, np.abs(theirs - np.arange(len(top))))).sum(axis=1)
        best = int(away.argmin())
        return langs[best], float(1 - away[best] / (size * len(top)))

    def run(batches):
        for b in batches:
            got = [place(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "lang_pred": [x for x, _ in got], "score": [x for _, x in got]}, schema)

    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, size: int = 400) -> DataFrame:
    """Learn from the rows whose crc32(doc_id) mod 3 is not 1, predict all."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    profiles = train(docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out), size)
    return predict(docs, profiles, size).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
