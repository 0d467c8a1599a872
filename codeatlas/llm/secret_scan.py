"""Secret scan in native expressions: candidates by pattern, false positives removed by a random forest.

Candidates are runs of 16 or more token characters with a digit, known forms of keys, and what is assigned to a name with a
secret word in it (8 or more characters, of one line; up to the closing quote where there is one, escaped or not), each with
the name or word before it. A run inside an assigned value is a candidate of its own. A forest of decision
trees over a candidate's length, character transitions, dictionary coverage, path and neighbouring words, trained on
labelled findings, becomes one SQL expression: the mean of its trees' CASE expressions.

Null or empty texts have no candidates. A candidate found several times in a text gives several rows, numbered in order;
repeated rows each give theirs; a null doc_id or path is carried. Values are not returned, only their sha2 hash. Extra columns are not read;
an empty table gives an empty result.
"""

from __future__ import annotations

import random
import string
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A run of token characters begins where none stands before it and has a digit. Equals signs end it only where no value follows them.
RUN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+(?:={1,2}(?![A-Za-z0-9+/_=-]))?"
#: Known forms need no digit.
KNOWN = r"(?<![A-Za-z0-9+/_-])(?:(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9+/_-])|gh[pousr]_[A-Za-z0-9]{20,}+|xox[abprs]-[A-Za-z0-9-]{8,}+|sk[_-][A-Za-z0-9_-]{16,}+|AIza[A-Za-z0-9_-]{30,}+)"
VALUE = f"(?:{RUN}|{KNOWN})"
#: A secret word as a part of a name.
SECRET_NAME = r"(?:(?i:passwords?|passwd|passphrase|pwd|secrets?|tokens?|api[_-]?keys?|credentials?|private[_-]?key|access[_-]?key)(?![a-z])|(?<![A-Za-z])(?i:pass|key|auth|private|access|bearer)(?![A-Za-z]))"
NAMED = rf"""(?<![A-Za-z0-9_.-])(?=[A-Za-z0-9_.-]*?{SECRET_NAME})[A-Za-z_][A-Za-z0-9_.-]*+["'`]?+[ \t]*+(?::=|=>|={{1,3}}|:)[ \t]*+["'`]?+"""
#: What is assigned to such a name: quoted, all up to the quote; else up to a blank or sign that ends a value. What VALUE takes whole is left to it.
_QUOTED = "|".join(rf"(?<={q})(?!{VALUE}{q})[^{q}\n]{{8,}}+(?={q})" for q in "\"'`")
_BARE = rf"""(?<!["'`])(?!{VALUE}(?:[\s"'`,;&<>(){{}}\[\]]|\z))[^\s"'`,;&<>(){{}}\[\]]{{8,}}+"""
#: Group 1 is a run or known form; group 2 is an assigned value, whose name alone is consumed, so that runs inside are found too.
CANDIDATE = f"({VALUE})|{NAMED}(?=({_QUOTED}|{_BARE}))"
#: Up to a word and an assignment sign before it.
BEFORE = r"""(?:(?<![A-Za-z0-9_.+/-])[A-Za-z_][A-Za-z0-9_.-]*+["']?+[ \t]*+[=:]?+[ \t]*+["']?+)?"""
#: Words that tell secrets from what looks like them.
SECRET_WORDS = "password passwd pwd pass secret token key apikey auth credential bearer private access".split()
PLAIN_WORDS = "id uuid guid hash sha md5 commit checksum digest etag card phone isbn build version sample url ref revision order".split()
DICTIONARY = "example test sample dummy placeholder changeme your default password secret token key user admin demo foo bar abc null none value string data name the and for with this that from http www com org html index content image page post".split()
FEATURES = ("length", "transitions", "letters", "digits", "uppers", "dictionary", "secret_word", "plain_word", "assigned", "sample_path", "hexadecimal", "known_form", "signs", "blanks", "quoted", "code")


def candidates(docs: DataFrame, path: Column) -> DataFrame:
    """doc_id, path, n (its number in the text), before, shown (before, without a word that is a candidate itself), value."""
    text = F.coalesce("text", F.lit(""))
    group = lambda k: F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(k))
    found = docs.select("doc_id", path.alias("path"), text.alias("text"), group(0).alias("hits")).where(F.size("hits") > 0)
    text, but_last = F.col("text"), lambda a: F.concat(F.array(F.lit("")), F.slice(a, 1, F.size(a) - 1))
    found = found.withColumns({"runs": group(1), "given": group(2)})
    # What stands between hits; the last piece is behind them all.
    gaps = F.slice(F.split("text", CANDIDATE, -1), 1, F.size("hits"))
    parts = {"hit": F.col("hits"), "run": F.col("runs"), "given": F.col("given"), "gap": gaps, "last": but_last(F.col("hits")), "last_given": but_last(F.col("given"))}
    c = found.select("doc_id", "path", F.posexplode(F.arrays_zip(*[x.alias(n) for n, x in parts.items()])).alias("n", "c")).select("doc_id", "path", F.col("n").cast("long").alias("n"), "c.*")
    # An assigned value is the next gap's beginning. A candidate may itself be the word before the next, but isn't shown.
    named, after = F.col("given") != "", F.col("last_given") != ""
    shown = F.when(after & F.startswith("gap", "last_given"), F.expr("substring(gap, length(last_given) + 1)")).when(after & (F.col("gap") != ""), F.lit("")).when(after, F.col("last")).otherwise(F.col("gap"))
    before = lambda x: F.when(named, F.col("hit")).otherwise(F.regexp_extract(x, f"{BEFORE}$", 0))
    return c.select("doc_id", "path", "n", before(F.concat("last", "gap")).alias("before"), before(shown).alias("shown"), F.when(named, F.col("given")).otherwise(F.col("run")).alias("value"))


def measured(found: DataFrame) -> DataFrame:
    """The features of each candidate (before, value, path), as columns."""
    v, low = F.col("value"), F.lower("before")
    n = F.length(v)
    runs = v
    for kind, mark in (("[a-z]+", "a"), ("[A-Z]+", "B"), ("[0-9]+", "0"), ("[^A-Za-z0-9]+", "-")):
        runs = F.regexp_replace(runs, kind, mark)
    count = lambda c: F.length(F.regexp_replace(v, f"[^{c}]", "")) / n
    named = lambda words: F.col("before").isNotNull() & low.rlike(f"(?:^|[^a-z])(?:[a-z]+_)?(?:{'|'.join(words)})(?:$|[^a-z])")
    values = {
        "length": n, "transitions": (F.length(runs) - 1) / n, "letters": count("A-Za-z"), "digits": count("0-9"), "uppers": count("A-Z"),
        "dictionary": 1 - F.length(F.regexp_replace(F.lower(v), "|".join(DICTIONARY), "")) / n,
        "secret_word": named(SECRET_WORDS) | F.col("before").rlike(SECRET_NAME), "plain_word": named(PLAIN_WORDS), "assigned": F.col("before").rlike("[=:]"),
        "sample_path": F.coalesce(F.lower("path").rlike("(?:^|/)(?:tests?|examples?|samples?|fixtures|docs?|mocks?)(?:/|$)"), F.lit(False)),
        "hexadecimal": v.rlike("^[0-9a-f]+$"), "known_form": v.rlike("^(?:AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{20,}$|^xox[abprs]-|^sk_live_|^sk-(?:[a-z]+-)?[A-Za-z0-9]{20,}|^AIza"),
        "signs": F.length(F.regexp_replace(v, "[A-Za-z0-9+/=_-]", "")) / n, "blanks": v.rlike("[ \\t]"), "quoted": F.col("before").rlike("[\"'`]$"),
        "code": v.rlike(r"^[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+$|^\$|\$\{|\{\{|^<.*>$|%\(|\(\)|\(['\"]|^[a-z]+://[^:@]*$|^[*.xX]+$"),
    }
    return found.withColumns({name: F.coalesce(values[name].cast("double"), F.lit(0.0)) for name in FEATURES})


@dataclass(frozen=True)
class Leaf:
    share: float

    def sql(self) -> str:
        return f"{self.share!r}D"


@dataclass(frozen=True)
class Split:
    feature: str
    at: float
    low: object
    high: object

    def sql(self) -> str:
        return f"CASE WHEN {self.feature} <= {self.at!r}D THEN {self.low.sql()} ELSE {self.high.sql()} END"


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, least: int, tried: int):
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return Leaf(round(float(y.mean()), 6))
    best = (1e-9, None, 0.0)
    impurity = y.mean() * (1 - y.mean())
    for f in rng.choice(x.shape[1], tried, replace=False):
        for cut in np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 25))):
            left = x[:, f] <= cut
            k = left.sum()
            if min(k, len(y) - k) < least:
                continue
            p, q = y[left].mean(), y[~left].mean()
            gain = impurity - (k * p * (1 - p) + (len(y) - k) * q * (1 - q)) / len(y)
            if gain > best[0]:
                best = (gain, f, cut)
    if best[1] is None:
        return Leaf(round(float(y.mean()), 6))
    left = x[:, best[1]] <= best[2]
    return Split(FEATURES[best[1]], float(best[2]), *(grow(x[m], y[m], rng, depth - 1, least, tried) for m in (left, ~left)))


def fit(findings: DataFrame, trees: int = 24, depth: int = 6, least: int = 4, tried: int = 5, most: int = 20_000, seed: int = 3) -> list:
    """A forest from at most `most` labelled findings (path, before, value, label), those of the lowest hash."""
    rows = measured(findings).orderBy(F.xxhash64("value", "before", "path"), "value", "before", "path", "label").limit(most).select(*FEATURES, "label").collect()
    if not rows:
        raise ValueError("no labelled findings to learn from")
    x, y = np.array([[r[f] for f in FEATURES] for r in rows], float), np.array([r["label"] for r in rows], float)
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trees):
        at = rng.integers(0, len(y), len(y))
        out.append(grow(x[at], y[at], rng, depth, least, tried))
    return out


def score(forest: list) -> Column:
    return F.expr("(" + " + ".join(t.sql() for t in forest) + f") / {len(forest)}")


def labelled_findings(spark: SparkSession, n: int = 3000, seed: int = 17) -> DataFrame:
    """Findings labelled as they are made: credentials of usual forms, and what scanners mistake for them."""
    r = random.Random(seed)
    some = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    hexa, alnum, upper = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_uppercase + string.digits
    word = lambda: "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randrange(1, 4)))
    name = lambda: r.choice(("password=", "passwd: ", "token = \"", "secret_key=", "api_key: '", "access_token=", "auth_token: ", "pwd=", "client_secret=\"", "PASSWORD=", "private_key = "))
    plain = lambda: r.choice((f"{word()} ", f"{word()} {word()} ", "commit ", "sha: ", "id=", "uuid: ", "checksum ", "ref ", "card ", "build ", "order_id = ", "", "", "etag: \""))
    place = lambda: r.choice(("src0/en/1.txt", "app/config.py", "lib/a/b.js", "README.md", "deploy/prod.env", "tests/x.py", "docs/a.md", "examples/c.py", "src7/de/9.txt"))
    secret = lambda: r.choice((name(), name(), "userPassword = '", "\"password\": \"", "db.password: ", "accessToken=`"))
    mixed = lambda k: "".join(r.sample(some(string.ascii_letters, k - 3) + some(string.digits, 2) + r.choice("!@#$%^*?._"), k))
    rows = []
    for _ in range(n):
        kind = r.randrange(18)
        if kind == 0:
            rows.append((f"{r.choice(('', word() + ' ', 'key = ', 'aws_access_key_id='))}", "AKIA" + some(upper[:26] + "234567", 16), 1))
        elif kind == 1:
            rows.append((name(), some(hexa, r.choice((16, 18, 20, 24, 32, 40, 64))), 1))
        elif kind == 2:
            rows.append((name(), some(alnum, r.randrange(16, 48)) + "7", 1))
        elif kind == 3:
            rows.append((r.choice((name(), word() + " ", "")), r.choice(("ghp_", "gho_")) + some(alnum, 36), 1))
        elif kind == 4:
            rows.append((name(), some(alnum + "+/", r.choice((40, 43, 64))) + "1", 1))
        elif kind == 5:
            rows.append((plain(), some(string.digits, 16), 0))
        elif kind == 6:
            rows.append((plain(), "-".join(some(hexa, k) for k in (8, 4, 4, 4, 12)), 0))
        elif kind == 7:
            rows.append((plain(), some(hexa, r.choice((32, 40, 64))), 0))
        elif kind == 8:
            rows.append((r.choice((name(), plain())), r.choice(("your_api_key_1234567", "example_password_123", "changeme_changeme_1", "test-token-0000000000", "dummy_secret_key_00000", "placeholder_value_123")), 0))
        elif kind == 9:
            rows.append((plain(), "_".join(word() for _ in range(r.randrange(3, 7))) + str(r.randrange(100)) + "_abcdefgh", 0))
        elif kind == 10:
            rows.append((plain(), "/".join(word() for _ in range(r.randrange(3, 6))) + f"/{r.randrange(10**6)}/index-html", 0))
        elif kind == 11:
            rows.append((plain(), f"{r.randrange(2000, 2030)}-{r.randrange(10, 13)}-{r.randrange(10, 29)}-{some(string.digits, 6)}", 0))
        elif kind == 12:
            rows.append((secret(), r.choice((mixed(r.randrange(8, 16)), mixed(r.randrange(8, 16)), "p@ss!" + word() + some(string.digits, 4), word() + word() + some(string.digits, r.randrange(2, 6)) + r.choice(("", "!", "#")))).ljust(8, "7"), 1))
        elif kind == 13:
            spelt = (r.choice(("password = \"", "userPassword = '", "\"password\": \"", "passwd=`")), (word() + word() + word() + word()).ljust(8, "e"), 1)
            rows.append(r.choice((spelt, (secret(), some(string.ascii_letters, r.randrange(12, 100)), 1))))
        elif kind == 14:
            rows.append((r.choice(("", word() + " ", "key = ", secret())), r.choice(("AKIA" + some(upper[:26], 16), "ghp_" + some(string.ascii_letters, 36), "xoxb-" + some(string.ascii_letters, 24), "sk-" + some(string.ascii_letters, 32))), 1))
        elif kind == 15:
            rows.append((r.choice(("key: ", "token: ", "access: ", "password: ", "secret = ", "token=", "auth = ", "pass: ")), r.choice((word() + word() + word() + word(), (word() + word() + word()).capitalize() + "s", "required", "optional", "undefined", "Optional", "important")).ljust(8, "e"), 0))
        elif kind == 16:
            rows.append((secret(), r.choice((f"os.environ.{word()}", f"process.env.{word().upper()}", f"self.{word()}.{word()}", f"${{{word().upper()}_KEY}}", f"{{{{ {word()}.{word()} }}}}", f"<your-{word()}-here>", f"https://{word()}.com/{word()}", "********", "xxxxxxxxxxxx", f"get_{word()}()")).ljust(8, "*"), 0))
        else:
            rows.append((r.choice(("\"password\": \"", "token = '", "key: \"", "secret=\"")), " ".join(word() for _ in range(r.randrange(3, 9))).capitalize().ljust(8, "a"), 0))
    return spark.createDataFrame([(place(), b, v, k) for b, v, k in rows], "path string, before string, value string, label int")


def scan(docs: DataFrame, path: Column, forest: list, threshold: float = 0.5) -> DataFrame:
    """doc_id, path, n, name (what stands before, unless it is a candidate), length, value_sha2, score, is_secret: a row for each candidate."""
    out = measured(candidates(docs, path)).withColumn("score", F.round(score(forest), 6))
    return out.select("doc_id", "path", "n", F.regexp_replace("shown", "[^A-Za-z0-9_.-]+", "").alias("name"), F.col("length").cast("long").alias("length"), F.sha2("value", 256).alias("value_sha2"), "score", (F.col("score") >= threshold).alias("is_secret"))
