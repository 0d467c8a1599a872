"""Token ids as patched frame-of-reference blocks.

A shard file holds whole documents in ascending doc_id order:

    magic "TKB1" | u32 block size | u64 documents | u64 tokens | u64 blocks
    i64 doc_id x documents | u8 is_null x documents | u64 tokens x documents
    u64 start of each block, from the start of the file, x blocks
    blocks: u32 values | u32 minimum | u8 width | u32 exceptions | u16 positions | u32 high parts | packed low bits

Each block subtracts its minimum and packs the low `width` bits of what remains, where `width` holds the
`percentile` of its values; the parts above `width` of the others are its exceptions.

Null or empty texts hold only the end id. A null doc_id sorts first. Repeated rows are all kept, ties in doc_id
ordered by a hash of the text; extra columns are not read; an empty table gives no shard and an empty result.
"""

from __future__ import annotations

import gc
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

HEAD = struct.Struct("<4sIQQQ")
BLOCK = struct.Struct("<IIBI")
MAGIC = b"TKB1"


def pack_block(values: np.ndarray, percentile: float = 0.9) -> bytes:
    low = int(values.min())
    rest = (values - np.uint32(low)).astype(np.uint32)
    at = np.partition(rest, k := min(len(rest) - 1, int(percentile * len(rest))))[k]
    width = int(at).bit_length()
    over = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    bits = np.unpackbits(rest.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    return b"".join((
        BLOCK.pack(len(values), low, width, len(over)), over.astype("<u2").tobytes(),
        (rest[over] >> np.uint32(width)).astype("<u4").tobytes(), np.packbits(bits.ravel(), bitorder="little").tobytes(),
    ))


def unpack_block(data: memoryview, at: int) -> np.ndarray:
    n, low, width, over = BLOCK.unpack_from(data, at)
    at += BLOCK.size
    where = np.frombuffer(data, "<u2", over, at)
    high = np.frombuffer(data, "<u4", over, at + 2 * over)
    at += 6 * over
    bits = np.unpackbits(np.frombuffer(data, np.uint8, (n * width + 7) // 8, at), count=n * width, bitorder="little").reshape(n, width)
    full = np.zeros((n, 32), np.uint8)
    full[:, :width] = bits
    out = np.packbits(full.ravel(), bitorder="little").view("<u4").astype(np.uint32)
    if over:
        out[where] |= high << np.uint32(width)
    return out + np.uint32(low)


def write_shard(doc_ids: list, counts: list[int], tokens: np.ndarray, block: int = 4096, percentile: float = 0.9) -> bytes:
    blocks = [pack_block(tokens[i : i + block], percentile) for i in range(0, len(tokens), block)]
    head = HEAD.pack(MAGIC, block, len(doc_ids), len(tokens), len(blocks))
    docs = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array([d is None for d in doc_ids], np.uint8).tobytes() + np.array(counts, "<u8").tobytes()
    first = len(head) + len(docs) + 8 * len(blocks)
    starts = first + np.concatenate([[0], np.cumsum([len(b) for b in blocks])])[:-1]
    return b"".join((head, docs, starts.astype("<u8").tobytes(), *blocks))


def read_shard(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """doc_ids, tokens of each document, all token ids of the file."""
    magic, _, docs, tokens, blocks = HEAD.unpack_from(data, 0)
    if magic != MAGIC:
        raise ValueError("not a token shard")
    at = HEAD.size
    ids = np.frombuffer(data, "<i8", docs, at)
    null = np.frombuffer(data, np.uint8, docs, at + 8 * docs)
    counts = np.frombuffer(data, "<u8", docs, at + 9 * docs).astype(np.int64)
    starts = np.frombuffer(data, "<u8", blocks, at + 17 * docs)
    view = memoryview(data)
    out = np.concatenate([np.zeros(0, np.uint32), *(unpack_block(view, int(s)) for s in starts)])
    if len(out) != tokens:
        raise ValueError("token shard is cut short")
    return [None if z else int(i) for i, z in zip(ids, null)], counts, out


def byte_letters() -> dict[int, int]:
    """Byte-level BPE's letter for each byte: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts as little-endian u32 bytes, remembered by word.

    The tokenizer drops white space and never joins pieces across it, so a text's ids are those of its
    space-separated words in turn. In words of code points up to U+00FF, which are in NFC and whose lower case is
    one code point each, plain punctuation at the end is a piece of its own, and a run of letters is one piece,
    which goes straight to the tokenizer's model. All other words pass through the whole tokenizer.
    """

    TAIL = ".,;:!?"
    TAIL_BYTES = TAIL.encode()

    def __init__(self, path: str, most: int = 300_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.most, self.words, self.parts = most, {}, {"": b""}

    def learn(self, words: set[bytes]) -> None:
        split, need, known, parts, tokenize = {}, set(), self.words, self.parts, self.model.tokenize
        for w in words:
            core = w.rstrip(self.TAIL_BYTES)
            if core.isalpha():  # of bytes: ASCII letters only
                core, tail = core.lower(), w[len(core) :]
                one = parts.get(core)
                if one is None:
                    one = parts[core] = array("I", [t.id for t in tokenize(core.decode())]).tobytes()
                if tail and tail not in parts:
                    parts[tail] = array("I", self.tokenizer.encode(tail.decode(), add_special_tokens=False).ids).tobytes()
                known[w] = one + parts[tail] if tail else one
                continue
            x = w.decode()
            if max(x) <= "\xff" and "<" not in x and "'" not in x:
                x = x.lower()
                core = x.rstrip(self.TAIL)
                split[w] = (core, x[len(core) :]) if core[-1:].isalpha() else (x, "")
            else:
                split[w] = (x, "")
            need.update(split[w])
        need -= self.parts.keys()
        whole = []
        for x in need:
            if x.isalpha() and max(x) <= "\xff":
                seen = x.lower().encode().decode("latin-1").translate(self.letters)
                parts[x] = array("I", [t.id for t in tokenize(seen)]).tobytes()
            else:
                whole.append(x)
        coded = self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)
        parts.update((x, array("I", e.ids).tobytes()) for x, e in zip(whole, coded))
        for w, (a, b) in split.items():
            known[w] = parts[a] + parts[b] if b else parts[a]

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        if len(self.words) > self.most:
            self.words.clear()
        if len(self.parts) > self.most:
            self.parts = {"": b""}
        collects = gc.isenabled()
        gc.disable()  # nothing here makes cycles, and each collection would walk the whole memory of words
        try:
            split = [t.split() for t in texts]
            self.learn(set().union(*split).difference(self.words))
            get = self.words.__getitem__
            return [b"".join(map(get, w)) for w in split]
        finally:
            if collects:
                gc.enable()


#: Documents in an Arrow batch: long texts lie in a worker several times.
BATCH = 1000

_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker, kept between its tasks, until `forget`."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def forget() -> None:
    """Let go of the worker's encoders: an idle worker would keep their words while other stages run beside it."""
    if _encoders:
        _encoders.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()


def slices(texts: list[bytes], most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of about `most` bytes, at least one text each."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 2, shard_tokens: int = 2_000_000, block: int = 4096, percentile: float = 0.9) -> DataFrame:
    """Encode `docs` (doc_id, text) into shards under `folder`; returns the manifest (path, first, n_docs, n_tokens, start).

    A try of a task writes files of its own; those of a lost try aren't in the manifest and are never read.
    """

    def shards(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        code, end = encoder(tokenizer_path), np.array([end_id], "<u4").tobytes()
        run, part, ids, coded, held, first = uuid.uuid4().hex, 0, [], [], 0, None

        def flush():
            nonlocal part, ids, coded, held
            path = f"{root}/{run}-{part}.tkb"
            counts = [len(b) // 4 for b in coded]
            with store.open_output_stream(path) as out:
                out.write(write_shard(ids, counts, np.frombuffer(b"".join(coded), "<u4"), block, percentile))
            row = pa.RecordBatch.from_pydict({"path": [path], "first": [ids[0]], "tie": [first], "n_docs": [len(ids)], "n_tokens": [held]}, schema)
            part, ids, coded, held = part + 1, [], [], 0
            return row

        for b in batches:
            texts = [t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()]
            names, ties = b.column("doc_id").to_pylist(), b.column("tie").to_pylist()
            for i, j in slices(texts):
                for d, tie, one in zip(names[i:j], ties[i:j], code(texts[i:j])):
                    if not ids:
                        first = tie
                    ids.append(d)
                    coded.append(one + end)
                    held += len(one) // 4 + 1
                    if held >= shard_tokens:
                        yield flush()
        if ids:
            yield flush()

    schema = pa.schema([("path", pa.string()), ("first", pa.int64()), ("tie", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    ranged = kept.repartitionByRange(common.partitions(docs.sparkSession), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    with common.small_batches(docs.sparkSession, BATCH):
        listed = common.save(ranged.mapInArrow(shards, "path string, first long, tie long, n_docs long, n_tokens long"), f"{folder}-manifest")
    before = Window.orderBy("first", "tie", "path").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return listed.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document, from the shards: doc_id, start, n_tokens, ids_crc32."""

    def docs(batches):
        from pyarrow import fs

        forget()
        store, _ = fs.FileSystem.from_uri(folder)
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist()):
                with store.open_input_stream(path) as f:
                    ids, counts, tokens = read_shard(f.readall())
                ends = np.cumsum(counts)
                raw = memoryview(tokens.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_pydict({"doc_id": ids, "start": start + ends - counts, "n_tokens": counts, "ids_crc32": crc}, schema)

    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    spread = manifest.select("path", "start").repartition(common.partitions(manifest.sparkSession), "path")
    return spread.mapInArrow(docs, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Write the shards of `docs` into a new shared folder and read them back."""
    folder = common.scratch_dir(docs.sparkSession) + "-tokens"
    return read(write(docs, folder, tokenizer_path, **options), folder)
