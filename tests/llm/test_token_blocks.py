import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeatlas.llm import registry, token_blocks

ODD = ["", None, "a", "The CAT's hat, isn't it? <|endoftext|> x<|startoftext|>y", "É́ T̈ ẞ ſ İstanbul ΣΑΣ", "naïve! ªº µ ß. 12,5% ...!?", "a b\x1cc d\u0085e", "日本語 テスト。", "don't. we'll, I'd! 'S 'T x's.", "\t\n\x0b\x0c\r ", "Thing. thing THING, thing;", "é. 12.", "🙂🙂!", "a" * 3000]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(registry.tokenizer_path())


def ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_encoder_matches_the_library(tokenizer):
    code = token_blocks.Encoder(registry.tokenizer_path())
    for t, got in zip(ODD, code([(t or "").encode() for t in ODD])):
        assert np.frombuffer(got, "<u4").tolist() == ids(tokenizer, t), t


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abÀÉéßµªſ'’.,!?<|> \n ́İsSdDreLL19½")), max_size=6))
def test_encoder_on_random_texts(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(registry.tokenizer_path())
    code = token_blocks.Encoder(registry.tokenizer_path(), most=3)
    assert [np.frombuffer(b, "<u4").tolist() for b in code([x.encode() for x in texts])] == [ids(t, x) for x in texts]


@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=300), st.floats(0, 1))
def test_block_round_trip(values, percentile):
    x = np.array(values, np.uint32)
    assert (token_blocks.unpack_block(memoryview(token_blocks.pack_block(x, percentile)), 0) == x).all()


def test_query_matches_brute_force(spark, tmp_path, tokenizer):
    rows = [(i * 3 - 4, t, "x", 1) for i, t in enumerate(ODD)] + [(5, ODD[3], "x", 1), (5, ODD[3], "x", 1), (None, "null id", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string, n_tokens long")
    got = token_blocks.encode(docs, registry.tokenizer_path(), shard_tokens=20, block=7).collect()
    want, at = [], 0
    for d, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        x = np.array([*ids(tokenizer, t), 2], "<u4")
        want.append((d, at, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_empty(spark):
    assert token_blocks.encode(spark.createDataFrame([], "doc_id long, text string"), registry.tokenizer_path()).count() == 0


def test_encoder_remembers_a_bounded_number_of_words(tokenizer):
    code, most = token_blocks.Encoder(registry.tokenizer_path()), 0
    for k in range(0, 420_000, 30_000):
        code([" ".join(f"w{i}x" for i in range(k, k + 30_000)).encode()])
        most = max(most, len(code.words), len(code.parts))
    assert most <= 340_000


def test_small_batches_while_writing_and_no_words_kept_after(spark, monkeypatch, tmp_path):
    import shutil

    path, limits, save = str(tmp_path / "tokenizer.json"), [], token_blocks.common.save
    shutil.copy(registry.tokenizer_path(), path)
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    monkeypatch.setattr(token_blocks.common, "save", lambda df, at: (limits.append(int(spark.conf.get(limit))), save(df, at))[1])
    before = spark.conf.get(limit)
    docs = spark.range(40).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    assert token_blocks.encode(docs, path).count() == 40
    assert max(limits) <= 1000 and spark.conf.get(limit) == before
    token_blocks.encoder(path)
    token_blocks.forget()
    assert not token_blocks._encoders
