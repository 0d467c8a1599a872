"""Quality rules: statistics of whole texts in native expressions, and a learned decision list over them.

Null texts count as empty: zero words, `base_failed` true. Each row is judged by itself, so repeated rows and ties get
equal verdicts; a null doc_id is kept as it is; columns beside doc_id and text are not read; an empty table gives an
empty result, and labels without both classes give a list without rules.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, words_of

WINDOW = 5
SYMBOLS = "#*$%&|<>"
#: What rules may test: name -> expression over the columns of `statistics`.
FEATURES = {
    "n_words": "double(n_words)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "bang_share": "n_bangs / greatest(n_words, 1)",
    "stop_share": "n_stops / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
}


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def statistics(docs: DataFrame, carry: Column | None = None) -> DataFrame:
    """doc_id and the counts of each whole text; with `carry`, also that as `carried`.

    No filter on the counts may be pushed below them (it would repeat them for each use): `row` is there to prevent it.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    carried = F.lit(None) if carry is None else carry
    a = docs.select("doc_id", carried.alias("carried"), text.alias("text"), words_of(text).alias("words"))
    b = a.select(
        "doc_id", "carried", "text", "words", F.size("words").cast("long").alias("n_words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{ASCII_SPACE}]")).alias("lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    c = b.select(
        "doc_id", "carried", "n_words",
        _without(F.col("text"), " \t\n\x0b\x0c\r").alias("n_space"), F.length("text").alias("n_chars"),
        _without(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        _without(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"), _without(F.col("text"), "0123456789").alias("n_digits"),
        _without(F.col("text"), "!?").alias("n_bangs"), _without(F.col("text"), ".;:").alias("n_stops"),
        F.size("lines").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("h")).alias("n_distinct"),
        F.transform(F.slice("h", WINDOW, F.greatest(F.size("h"), F.lit(1))), lambda x, i: F.xxhash64(*[F.get("h", i + k) for k in range(WINDOW - 1)], x)).alias("windows"),
    )
    # Only texts with a window found twice go on to sort their windows.
    d = c.withColumn("twice", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.array_sort(F.transform("windows", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    same = lambda s, i: F.coalesce(F.get("twice", i).x == s.x, F.lit(False))
    e = d.withColumn("at", F.array_sort(F.transform(F.filter("twice", lambda s, i: F.when(i > 0, same(s, i - 1)).otherwise(F.lit(False)) | same(s, i + 1)), lambda s: s.i)))
    steps = F.transform("at", lambda x, i: F.coalesce(F.least(F.lit(WINDOW), F.get("at", i + 1) - x), F.lit(WINDOW)))
    return e.select(
        "doc_id", "n_words", (F.col("n_chars") - F.col("n_space")).cast("long").alias("word_chars"), "n_symbols", "n_dup_lines",
        F.coalesce(F.aggregate(steps, F.lit(0), lambda s, x: s + x), F.lit(0)).cast("long").alias("n_repeat_words"),
        "n_upper", "n_digits", "n_bangs", "n_stops", "n_lines", "n_distinct", "carried", F.monotonically_increasing_id().alias("row"),
    )


BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"


@dataclass(frozen=True)
class Rule:
    """Texts that meet all of (feature, is_at_least, threshold) are rejected."""

    tests: tuple[tuple[str, bool, float], ...]

    def sql(self) -> str:
        return " AND ".join(f"{FEATURES[f]} {'>=' if up else '<='} {t!r}D" for f, up, t in self.tests)

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for f, up, t in self.tests:
            out &= x[f] >= t if up else x[f] <= t
        return out


def learn(x: dict[str, np.ndarray], bad: np.ndarray, prune_share: float = 0.33, min_precision: float = 0.9, min_cover: int = 5, max_rules: int = 16, max_tests: int = 4, cuts: int = 48, seed: int = 7) -> list[Rule]:
    """Sequential covering: grow a conjunction by FOIL gain on one part of the rows, prune it on the other, keep it if it holds there, take out what it covers."""
    live = np.ones(len(bad), bool)
    prune = np.random.default_rng(seed).random(len(bad)) < prune_share
    thresholds = {f: np.unique(np.quantile(v, np.linspace(0, 1, cuts))) if len(v) else v for f, v in x.items()}
    rules: list[Rule] = []
    while len(rules) < max_rules and (bad & live & ~prune).sum() >= min_cover:
        tests: list[tuple[str, bool, float]] = []
        inside = live & ~prune
        while len(tests) < max_tests and (inside & ~bad).any():
            p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
            best = (0.0, None, None)
            for f, cut in thresholds.items():
                for t in cut:
                    for up in (True, False):
                        now = inside & (x[f] >= t if up else x[f] <= t)
                        if (p := (now & bad).sum()) >= min_cover:
                            gain = p * (np.log2(p / (p + (now & ~bad).sum())) - np.log2(p0 / (p0 + n0)))
                            if gain > best[0] + 1e-9:
                                best = (gain, (f, up, float(t)), now)
            if best[1] is None:
                break
            tests.append(best[1])
            inside = best[2]

        def worth(k: int) -> float:
            now = Rule(tuple(tests[:k])).covers(x) & live & prune
            return ((now & bad).sum() - (now & ~bad).sum()) / max(1, now.sum())

        if not tests:
            break
        keep = max(range(len(tests), 0, -1), key=worth)
        rule = Rule(tuple(tests[:keep]))
        now = rule.covers(x) & live
        if ((now & bad).sum() + 1) / (now.sum() + 2) < min_precision:
            rule = Rule(tuple(tests))
            now = rule.covers(x) & live
            if ((now & bad).sum() + 1) / (now.sum() + 2) < min_precision:
                break
        rules.append(rule)
        live &= ~now
    return rules


def fit(docs: DataFrame, labels: DataFrame, most: int = 8_000, **options) -> list[Rule]:
    """Learn from at most `most` labelled rows (those of the lowest hash of doc_id), which bounds what the driver gets and what is broadcast."""
    some = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", F.col("quality").alias("label")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(most)
    found = statistics(docs.join(F.broadcast(some.select("doc_id").distinct()), "doc_id", "left_semi")).join(F.broadcast(some), "doc_id")
    # Base failures are left out here: as a filter, Catalyst would push the test, and so all the counting, below the counts.
    got = found.select(F.expr("int(label = 0)").alias("bad"), *[F.expr(sql).alias(f) for f, sql in FEATURES.items()], "doc_id", F.expr(BASE_FAILED).alias("failed")).collect()
    rows = sorted((r for r in got if not r["failed"]), key=lambda r: (r["doc_id"], r["bad"]))
    if not rows:
        return []
    return learn({f: np.array([r[f] for r in rows], float) for f in FEATURES}, np.array([r["bad"] for r in rows], bool), **options)


def verdict(rules: list[Rule]) -> tuple[Column, Column]:
    """The ordered conditional expression: number of the rule that rejects (null: none), and whether the text is kept."""
    sql = "CASE WHEN " + BASE_FAILED + " THEN 0" + "".join(f" WHEN {r.sql()} THEN {k}" for k, r in enumerate(rules, 1)) + " END"
    return F.expr(sql).cast("int"), F.expr(sql).isNull()


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    rule, kept = verdict(rules)
    return statistics(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.expr(BASE_FAILED).alias("base_failed"), kept.alias("kept"), rule.alias("rule"))


def keep(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of `docs` that are kept, with all their columns."""
    kept = statistics(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns])).where(verdict(rules)[1] & (F.col("row") >= 0))
    return kept.select("carried.*")
