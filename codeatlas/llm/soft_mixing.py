"""Mixing documents to target weights by soft domain membership.

A multinomial logistic classifier, learned from a table of labelled documents, gives each document's posterior over
domains. Document rates r >= 0 then solve, by projected gradient steps, the least squares problem

    sum over domains of (sum over documents of tokens * posterior * r  -  target)^2, whitened by the domains' Gram matrix,

starting from r = 1, so that rates stay near one where targets allow. What steps need from the documents are sums by
domain, computed by Spark; no list of documents reaches the driver.

Null or empty texts have no tokens, the posterior of an empty text, and so do not move the totals. Rows are rated each by
themselves; repeated rows count each time. A null doc_id gets its rate, too. Extra columns are not read by `rates`, and
`mix` keeps the columns of its input. An empty table gives an empty result; without labels all rates are 1.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, save, scratch_dir, words_of

#: Pieces of a text that the classifier counts: words in lower case, and runs of signs.
PIECE = re.compile(r"[^\W_]+|[^\w\s]+")


class Classifier:
    """Logistic regression over the pieces, and beginnings of words, that tell the sample's domains apart best."""

    def __init__(self, domains: list[str], pieces: list[str], weights: np.ndarray, bias: np.ndarray):
        self.domains, self.at, self.weights, self.bias = domains, {p: k for k, p in enumerate(pieces)}, weights, bias

    @staticmethod
    def stems(pieces) -> set[str]:
        """The first four letters of longer words, marked by ^."""
        return {f"^{p[:4]}" for p in pieces if len(p) > 4 and p[0].isalpha()}

    @classmethod
    def features(cls, text: str | None, at: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Positions and values: presence, and for pieces also the square root of their share. One more feature is the share of letters in upper case."""
        text = text or ""
        n = Counter(PIECE.findall(text.lower()))
        total = max(1, sum(n.values()))
        found = [(at[p], 0.3 + (n[p] / total) ** 0.5) for p in n.keys() & at.keys()]
        found += [(at[p], 0.3) for p in cls.stems(n) & at.keys()]
        upper = sum(map(str.isupper, text)) / max(1, len(text))
        return np.array([*(k for k, _ in found), len(at)], np.int64), np.array([*(v for _, v in found), upper])

    @staticmethod
    def pieces_of(text: str | None) -> set[str]:
        """The pieces of a text, and the stems of its words."""
        here = set(PIECE.findall((text or "").lower()))
        return here | Classifier.stems(here)

    @classmethod
    def train(cls, domains: list[str], pieces: list[str], rows: list[tuple[str, np.ndarray, np.ndarray]], rounds: int = 400, ridge: float = 1e-4) -> Classifier:
        """rows: domain, positions and values of features."""
        x = np.zeros((len(rows), len(pieces) + 2), np.float32)
        for i, (_, where, value) in enumerate(rows):
            x[i, where] = value
        x[:, -1] = 0.3
        y = np.zeros((len(rows), len(domains)), np.float32)
        y[np.arange(len(rows)), [domains.index(d) for d, _, _ in rows]] = 1
        w = np.zeros((x.shape[1], len(domains)), np.float32)
        m, v = np.zeros_like(w), np.zeros_like(w)
        for k in range(1, rounds + 1):  # Adam over all rows
            z = x @ w
            p = np.exp(z - z.max(axis=1, keepdims=True))
            g = x.T @ (p / p.sum(axis=1, keepdims=True) - y) / len(rows) + ridge * w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= 0.3 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        return cls(domains, pieces, w[:-1].astype(np.float64), 0.3 * w[-1].astype(np.float64))

    @classmethod
    def fit(cls, rows: list[tuple[str, str]], **options) -> Classifier:
        """The same from rows (domain, text) on the driver."""
        size, seen = Counter(d for d, _ in rows), {}
        for d, t in rows:
            for p in cls.pieces_of(t):
                seen.setdefault(p, Counter())[d] += 1
        pieces = chosen([(p, n) for p, n in seen.items()], size, **options)
        at = {p: k for k, p in enumerate(pieces)}
        return cls.train(sorted(size), pieces, [(d, *cls.features(t, at)) for d, t in rows])

    def posterior(self, text: str | None) -> np.ndarray:
        where, value = self.features(text, self.at)
        z = value @ self.weights[where] + self.bias
        p = np.exp(z - z.max())
        return p / p.sum()


def domain_table(labels: DataFrame) -> DataFrame:
    """doc_id, domain of a labels table: toxic, low (quality 0) or good."""
    return labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").select("doc_id", F.expr("CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'low' ELSE 'good' END").alias("domain"))


#: Of the pieces that stand in `LEAST_SHARE` of the sample at least, the `MOST_PIECES` that tell domains apart best, by a likelihood ratio of `LEAST_GAIN` at least.
MOST_PIECES, LEAST_SHARE, LEAST_GAIN = 200, 0.003, 12.0


def least_rows(size: Counter) -> float:
    return max(2, LEAST_SHARE * size.total())


def chosen(counts: list[tuple[str, Counter]], size: Counter) -> list[str]:
    """The pieces and stems of the greatest likelihood ratio between their presence and the domain."""

    def gain(n: Counter) -> float:
        share = n.total() / size.total()
        cells = [(n[d], share * size[d]) for d in size] + [(size[d] - n[d], (1 - share) * size[d]) for d in size]
        return 2 * sum(have * np.log(have / due) for have, due in cells if have > 0 and due > 0)

    ranked = sorted((-gain(n), p) for p, n in counts if n.total() >= least_rows(size))
    return [p for g, p in ranked[:MOST_PIECES] if -g >= LEAST_GAIN]


def learn(docs: DataFrame, labelled: DataFrame, most: int = 4000) -> Classifier | None:
    """Fit on the whole texts of at most `most` rows of `labelled` (doc_id, domain), those of the lowest hash.

    Of several texts of a doc_id the one of the lowest hash counts. Texts are read where they lie: the driver gets counts of
    the pieces that enough texts have, and each text's values of the chosen ones.
    """
    spark, at = docs.sparkSession, scratch_dir(docs.sparkSession)
    some = labelled.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(most)
    found = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id", "domain").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    found = save(found, f"{at}-labelled")
    size = Counter({r["domain"]: r["count"] for r in found.groupBy("domain").count().collect()})
    if not size:
        return None
    domains = sorted(size)

    def count(batches):
        for b in batches:
            seen: Counter = Counter()
            for d, t in zip(b.column("domain").to_pylist(), b.column("text").to_pylist()):
                seen.update((p, d) for p in Classifier.pieces_of(t))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in seen], pa.string()), pa.array([d for _, d in seen], pa.string()), pa.array(seen.values(), pa.int64())], names=["piece", "domain", "n"])

    pieces = found.select("domain", "text").mapInArrow(count, "piece string, domain string, n long")
    wide = pieces.groupBy("piece").agg(F.sum("n").alias("all"), *[F.sum(F.when(F.col("domain") == d, F.col("n")).otherwise(0)).alias(f"n{k}") for k, d in enumerate(domains)])
    # The ratio in expressions, so that only the best reach the driver.
    total, all_ = float(size.total()), F.col("all")
    part = lambda have, due: F.when(have > 0, have * F.log(have / due)).otherwise(0.0)
    gain = sum((part(F.col(f"n{k}"), all_ / total * size[d]) + part(size[d] - F.col(f"n{k}"), (1 - all_ / total) * size[d]) for k, d in enumerate(domains)), F.lit(0.0))
    best = wide.where((all_ >= least_rows(size)) & (all_ < total)).withColumn("gain", F.round(gain, 6)).orderBy(F.desc("gain"), "piece").limit(2 * MOST_PIECES).collect()
    names = chosen([(r["piece"], Counter({d: r[f"n{k}"] for k, d in enumerate(domains)})) for r in best], size)
    place = {p: k for k, p in enumerate(names)}

    def measure(batches):
        for b in batches:
            got = [Classifier.features(t, place) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("domain"), pa.array([w.tolist() for w, _ in got], pa.list_(pa.int64())), pa.array([v.tolist() for _, v in got], pa.list_(pa.float64()))], names=["doc_id", "domain", "at", "value"])

    rows = found.mapInArrow(measure, "doc_id long, domain string, at array<long>, value array<double>").collect()
    remove(spark, f"{at}-labelled")
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["domain"]))
    return Classifier.train(domains, names, [(r["domain"], np.array(r["at"]), np.array(r["value"])) for r in rows])


def memberships(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """doc_id, tokens (words of the whole text) and the posterior p."""
    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            p = [classifier.posterior(t).tolist() for t in texts]
            n = [len((t or "").encode().split()) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tie"), pa.array(n, pa.int64()), pa.array(p, pa.list_(pa.float64()))], names=["doc_id", "tie", "tokens", "p"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text").mapInArrow(run, "doc_id long, tie long, tokens long, p array<double>")


def rates(docs: DataFrame, classifier: Classifier, targets: dict[str, float], anchor: str, steps: int = 24, tolerance: float = 1e-4, keep_every: int = 8, only_lower: bool = False) -> DataFrame:
    """doc_id, tokens, p, rate, copies. The anchor domain's tokens stay as many as they are, which sets the total; without one (no such domain, or no target for it) the total stays.

    With `only_lower`, targets of other domains are ceilings: what lies below its target stays as it is, so that a few
    documents of a domain that an earlier stage has removed aren't repeated many times over.
    """
    spark, at, k = docs.sparkSession, scratch_dir(docs.sparkSession), len(classifier.domains)
    held = save(memberships(docs, classifier).withColumn("rate", F.lit(1.0)), f"{at}-rates-0")
    p = [F.col("p")[i] for i in range(k)]
    sums = held.agg(*[F.sum(F.col("tokens") * x) for x in p], *[F.sum(F.col("tokens") * x * y) for x in p for y in p]).first()
    have, gram = np.array([x or 0 for x in sums[:k]], float), np.array([x or 0 for x in sums[k:]], float).reshape(k, k)
    scale = max(have.sum(), 1.0)
    share = np.array([targets.get(d, 0.0) for d in classifier.domains])
    base = have[classifier.domains.index(anchor)] / targets[anchor] if anchor in classifier.domains and targets.get(anchor) else have.sum()
    want = share / share.sum() * base / scale if share.sum() else have / scale
    if only_lower:
        want = np.where([d == anchor for d in classifier.domains], want, np.minimum(want, have / scale))
    invert = np.linalg.pinv(gram / scale + 1e-9 * np.eye(k))
    rate, now = F.col("rate"), have / scale
    for step in range(1, steps + 1):
        if np.abs(now - want).max() <= tolerance * max(want.max(), 1e-12):
            break
        move = invert @ (now - want)
        rate = F.greatest(F.lit(0.0), rate - sum((F.lit(float(m)) * x for m, x in zip(move, p)), F.lit(0.0)))
        if step % keep_every == 0:
            held = save(held.withColumn("rate", rate), f"{at}-rates-{step}")
            remove(spark, f"{at}-rates-{step - keep_every}")
            rate = F.col("rate")
        now = np.array([x or 0 for x in held.agg(*[F.sum(F.col("tokens") * x * rate) for x in p]).first()], float) / scale
    # A document is taken floor(rate + u) times, u being its own number in [0, 1).
    u = F.pmod(F.xxhash64(F.lit("mix"), "doc_id", "tie"), F.lit(1 << 30)) / float(1 << 30)
    return held.withColumn("rate", rate).withColumn("copies", F.floor(F.col("rate") + u).cast("int")).select("doc_id", "tie", "tokens", "p", "rate", "copies")


def mix(docs: DataFrame, rated: DataFrame) -> DataFrame:
    """The rows of docs, each as often as its copies say."""
    names = [F.col(f"d.`{c}`") for c in docs.columns]
    once = rated.groupBy("doc_id", "tie").agg(F.max("copies").alias("n")).where("n > 0").alias("r")
    joined = docs.alias("d").join(once, F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.xxhash64("d.text") == F.col("r.tie")))
    return joined.select(F.struct(*names).alias("held"), F.explode(F.sequence(F.lit(1), F.col("r.n")))).select("held.*")
