import re
from collections import defaultdict

import pytest

from codeatlas.llm import ngram_join


def brute(rows, size=3, num=9, den=10):
    sets = []
    for _, t in rows:
        low = (t or "").translate({c: c + 32 for c in range(65, 91)})
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    meet = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            meet[x].append(i)
    pairs = {(i, j) for v in meet.values() for i in v for j in v if i < j}
    for i, j in pairs:
        both = len(sets[i] & sets[j])
        if den * both >= num * len(sets[i] | sets[j]):
            up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def got(spark, rows, **options):
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n long, node string")
    return sorted(map(tuple, ngram_join.link(docs, **options).collect()))


def made(seed, groups=12, near=14, length=60):
    import random

    r = random.Random(seed)
    word = lambda: r.choice("abcdefgh") + str(r.randrange(300))
    common = [word() for _ in range(12)]
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(r.randrange(5, length))]
        chain = base
        for _ in range(r.randrange(near)):
            x = list(r.choice((base, chain)))
            for _ in range(r.randrange(3)):
                x[r.randrange(len(x))] = word()
            if r.random() < 0.3:
                x = x + common
            chain = x
            rows.append(x)
    ids = r.sample(range(10_000), len(rows))
    return [(d, r.choice((" ", "\n", "\t ")).join(x).swapcase() if r.random() < 0.1 else " ".join(x)) for d, x in zip(ids, rows)]


EDGE = [(1, None), (2, ""), (3, " \n "), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one two"), (8, "a a a a a a"), (9, "a a a"), (10, "É b c"), (11, "é b c"), (12, "x " * 5000), (13, "X\tx " * 2500)]


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rows = made(seed) + made(seed + 50, groups=4, near=12, length=700) + [(d + 20_000, t) for d, t in EDGE] if seed == 1 else made(seed, groups=30)
    rows = list({d: (d, t) for d, t in rows}.values())
    assert got(spark, rows, grams_per_bucket=2000) == brute(rows)


def test_other_parameters_match_brute_force(spark):
    rows = made(5, groups=16)
    assert got(spark, rows, size=5, num=4, den=5) == brute(rows, 5, 4, 5)


def test_long_documents_with_a_common_passage(spark, monkeypatch):
    """Many documents of one long passage and a part of their own that keeps them apart, some near copies, and chunks of a few documents."""
    import random

    monkeypatch.setattr(ngram_join, "CHUNK_BYTES", 60_000)
    r = random.Random(3)
    common = [f"c{i}" for i in range(1500)]
    rows = []
    for k in range(60):
        own = [f"d{k}x{i}" for i in range(r.choice((150, 165, 170, 200)))]
        rows.append((k, " ".join(common + own)))
        if k % 6 == 0:
            rows.append((1000 + k, " ".join(common[3:] + own + [f"e{k}"])))
    rows += [(5000 + k, " ".join(["one", "two", "three", *[f"q{k}y{i}" for i in range(40)]])) for k in range(100)]
    assert got(spark, rows, grams_per_bucket=5000) == brute(rows)


def test_chunks_are_bounded():
    import pyarrow as pa

    b = pa.record_batch({"text": ["x" * n for n in (5, 9_000_000, 7, 7_999_990, 3, 2, 8)] + [None] * 1500})
    sizes = [(len(c), sum(len(t or "") for t in c.column("text").to_pylist())) for c in ngram_join.chunks([b, b.slice(0, 0)], "text")]
    assert sum(n for n, _ in sizes) == 1507 and all(n <= 1000 and (size <= 8_000_000 or n == 1) for n, size in sizes)


def test_repeated_and_nameless_rows(spark):
    out = got(spark, [(3, "a b c d"), (3, "a b c d"), (7, "A b c d")])
    assert out == [(3, 2, 3), (3, 2, 3), (7, 2, 3)]
    docs = spark.createDataFrame([(None, "a b c d"), (4, "a b c d")], "doc_id long, text string")
    assert set(map(tuple, ngram_join.link(docs).collect())) == {(None, 2, None), (4, 2, 4)}


def test_empty(spark):
    assert got(spark, []) == []
