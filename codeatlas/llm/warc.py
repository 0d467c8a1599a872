"""Content-addressed WARC archive.

An archive is a folder of three tables. `payloads` holds the bytes of each different payload once, under its SHA-256;
`first` holds the exact header bytes (WARC header and HTTP header) of the record that each payload was written for, and
`others` those of all other records: revisits, and equal payloads too short to be shared. `payloads` and `first` are
bucketed by the digest in the same way, so that records are put together again by a join that moves nothing; no payload is
ever in a shuffle by a key that many records share. Every record that is read has its digests and lengths verified, and a
mismatch is an error. `export_files` writes records to gzipped WARC files, `parse_files` reads such files, also foreign ones.

Of equal payloads of at least `least` bytes, the record with the largest page_id is the response (null is the smallest; of
rows with that page_id any one), the others revisit it. Null html is an empty payload; empty and long ones are treated like
any other. Repeated rows each give a record. Null page_ids and urls are carried, line breaks in urls are percent-encoded,
extra columns are not read, and an empty table gives an empty archive.
"""

from __future__ import annotations

import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

END = "\r\n\r\n"
#: How the format names an identical payload, and base32's letters.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32, BASE32_HEX = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"
#: Fixed value: no date is given for pages.
DATE = "1970-01-01T00:00:00Z"


@dataclass
class Archive:
    payloads: DataFrame
    first: DataFrame
    others: DataFrame


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hex digits are four letters."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), BASE32_HEX, BASE32)


def bytes_of(text: str | Column) -> Column:
    return F.coalesce(F.encode(text, "UTF-8"), F.encode(F.lit(""), "UTF-8"))


def urn(page_id: Column, row: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), row.cast("string"), F.lit(">"))


def heads(pages: DataFrame, folder: str, least: int) -> DataFrame:
    """key, is_first, head of each page: its record's exact header bytes. No payload is moved."""
    payload = bytes_of("html")
    facts = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.unhex(F.sha2(payload, 256)).alias("key"), base32_sha1(payload).alias("digest"),
        F.octet_length(payload).cast("long").alias("size"), F.monotonically_increasing_id().alias("row"),
    )
    facts = common.save(facts, f"{folder}/facts")  # rows keep the numbers that they have here
    top = facts.groupBy("key").agg(F.max(F.struct("page_id", "row")).alias("top"))
    rows = facts.join(top, "key")
    is_first = F.col("row") == F.col("top.row")
    response = is_first | (F.col("size") < least)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    held = F.octet_length(http) + F.when(response, F.col("size")).otherwise(0)
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(response, "response").otherwise("revisit")), line("WARC-Record-ID", urn(F.col("page_id"), F.col("row"))), line("WARC-Date", F.lit(DATE)),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")), line("Content-Type", F.lit("application/http;msgtype=response")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(response, F.lit("")).otherwise(F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", urn(F.col("top.page_id"), F.col("top.row"))))),
        F.lit("Content-Length: "), held.cast("string"), F.lit(END), http,
    )
    return rows.select("key", is_first.alias("is_first"), F.encode(head, "UTF-8").alias("head"))


def bucketed(df: DataFrame, path: str, buckets: int) -> DataFrame:
    """Write a table in buckets of `key` and read it as such. Its name in the catalogue is needed for that only."""
    spark, name = df.sparkSession, f"warc_{uuid.uuid4().hex}"
    df.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(buckets, "key").sortBy("key").saveAsTable(name)
    common.at_exit(spark, path)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay, as they have a path of their own
    return out


def store(heads: DataFrame, payloads: DataFrame, folder: str) -> Archive:
    """heads: key, is_first, head; payloads: key, payload with copies. Copies meet before the shuffle and are written once."""
    buckets = common.partitions(heads.sparkSession)
    heads = common.save(heads, f"{folder}/heads")
    once = payloads.groupBy("key").agg(F.first("payload").alias("payload"))
    held = bucketed(once, f"{folder}/payloads", buckets)
    first = bucketed(heads.where("is_first").select("key", "head").repartition(buckets, "key"), f"{folder}/first", buckets)
    return Archive(held, first, heads.where("NOT is_first").select("key", "head"))


def write(pages: DataFrame, folder: str, least: int = 0) -> Archive:
    """A record for each row of `pages` (page_id, url, html)."""
    payload = bytes_of("html")
    return store(heads(pages, folder, least), pages.select(F.unhex(F.sha2(payload, 256)).alias("key"), payload.alias("payload")), folder)


def verified(value: Column, ok: Column, what: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(f"WARC archive: {what}")))


def restore_first(archive: Archive) -> DataFrame:
    """key, record: the original bytes of the records that hold a payload's first place, its digest verified."""
    payload = verified(F.col("payload"), F.unhex(F.sha2("payload", 256)) == F.col("key"), "a payload differs from its digest")
    return archive.first.join(archive.payloads, "key").select("key", F.concat("head", payload, F.encode(F.lit(END), "UTF-8")).alias("record"))


def field(head: Column, name: str) -> Column:
    """A field's value in header text; null if it isn't there."""
    return F.nullif(F.regexp_extract(head, rf"(?i)\r\n{name}:[ \t]*([^\r\n]*)", 1), F.lit(""))


def is_revisit(head: Column) -> Column:
    return field(head.cast("string"), "WARC-Type") == "revisit"


def restore_others(archive: Archive) -> DataFrame:
    """key, record of all other records: revisits end after their headers, short responses get their payload by a join."""
    end = F.encode(F.lit(END), "UTF-8")
    visits = archive.others.where(is_revisit(F.col("head"))).select("key", F.concat("head", end).alias("record"))
    short = archive.others.where(~is_revisit(F.col("head")))
    payload = verified(F.col("payload"), F.unhex(F.sha2("payload", 256)) == F.col("key"), "a payload differs from its digest")
    return visits.unionByName(short.join(archive.payloads, "key").select("key", F.concat("head", payload, end).alias("record")))


def restore(archive: Archive) -> DataFrame:
    """key, record: the exact bytes of every record."""
    return restore_first(archive).unionByName(restore_others(archive))


def parse(records: DataFrame) -> DataFrame:
    """The columns of `records` but `record`, with page_id, record_type, refers_to, digest (as its header says) and payload, all read from the record's bytes."""
    others = [c for c in records.columns if c != "record"]
    text = F.col("record").cast("string")
    split = records.select(*others, "record", F.substring_index(text, END, 1).alias("head"))
    size = field(F.col("head"), "Content-Length").cast("int")
    split = split.select(*others, "head", F.substring(F.col("record"), F.octet_length("head") + F.lit(5), size).alias("block"), size.alias("size"), F.octet_length("record").alias("all"))
    whole = F.col("all") == F.octet_length("head") + F.lit(8) + F.col("size")
    http = F.octet_length(F.substring_index(F.col("block").cast("string"), END, 1)) + F.lit(5)
    number = lambda name: F.nullif(F.regexp_extract(field(F.col("head"), name), r"<urn:x-page:(-?\d+):", 1), F.lit("")).cast("long")
    return split.select(
        *others, number("WARC-Record-ID").alias("page_id"), field(F.col("head"), "WARC-Type").alias("record_type"), number("WARC-Refers-To").alias("refers_to"),
        F.substring_index(field(F.col("head"), "WARC-Payload-Digest"), ":", -1).alias("digest"), verified(F.substring(F.col("block"), http, F.col("size")), whole, "a record is cut short").alias("payload"),
    )


def describe(archive: Archive, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, read back from its bytes. Revisits take length and digest from the record that holds their payload, and must name that digest."""
    asked = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def facts(records: DataFrame) -> DataFrame:
        rows = parse(records).withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "computed": base32_sha1(F.col("payload"))})
        return rows.select("key", "page_id", "payload_bytes", verified(F.col("computed"), F.col("computed") == F.col("digest"), "a payload differs from its record's digest").alias("payload_digest"), "record_type", "refers_to")

    first = common.save(facts(restore_first(archive)), f"{folder}/described")
    others = restore_others(archive)
    kind = is_revisit(F.substring_index(F.col("record").cast("string"), END, 1))
    visits = parse(others.where(kind)).drop("payload").join(first.select("key", "payload_bytes", "payload_digest"), "key")
    named = verified(F.col("payload_digest"), F.col("payload_digest") == F.col("digest"), "a revisit names another digest")
    visits = visits.select("page_id", "payload_bytes", named.alias("payload_digest"), "record_type", "refers_to")
    return first.select(*asked).unionByName(visits).unionByName(facts(others.where(~kind)).select(*asked))


def archived(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write the records of `pages` into a new shared folder and read them back."""
    folder = common.scratch_dir(pages.sparkSession) + "-warc"
    common.at_exit(pages.sparkSession, folder)
    return describe(write(pages, folder, least), folder)


def export_files(records: DataFrame, folder: str, file_bytes: int = 1_000_000_000) -> DataFrame:
    """Write `records` (record) as gzipped WARC files, a member for each; returns path, offset and length of every one.

    A try of a task writes files of its own; those of a lost try aren't in the list.
    """

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name, part, at, out = uuid.uuid4().hex, 0, 0, None
        for b in batches:
            rows = []
            for record in b.column("record"):
                if out is None or at >= file_bytes:
                    if out is not None:
                        out.close()
                    path, part, at = f"{root}/{name}-{part}.warc.gz", part + 1, 0
                    out = store.open_output_stream(path, compression=None)
                pack = zlib.compressobj(wbits=31)
                member = pack.compress(record.as_buffer()) + pack.flush()
                out.write(member)
                rows.append((path, at, len(member)))
                at += len(member)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["path", "offset", "length"])
        if out is not None:
            out.close()

    with common.small_batches(records.sparkSession, 500):
        return common.save(records.select("record").mapInArrow(run, "path string, offset long, length long"), f"{folder}-list")


def members(stream, gzipped: bool, step: int = 1 << 20):
    """Decompressed pieces of a stream of gzip members, or its pieces as they are."""
    rest, unpack = b"", None
    while piece := rest or stream.read(step):
        rest = b""
        if not gzipped:
            yield piece
            continue
        unpack = unpack or zlib.decompressobj(wbits=31)
        yield unpack.decompress(piece)
        if unpack.eof:
            rest, unpack = unpack.unused_data, None


def records_in(pieces):
    """The bytes of each record of a WARC file. Work is linear in the file."""
    held, at = bytearray(), 0

    def need(n: int) -> bool:
        nonlocal held, at
        if at > 1 << 20:
            del held[:at]
            at = 0
        while len(held) - at < n:
            piece = next(pieces, None)
            if piece is None:
                return False
            held += piece
        return True

    while need(1):
        seen = at
        while (end := held.find(b"\r\n\r\n", seen)) < 0:
            size, seen = len(held) - at, max(at, len(held) - 3)
            back = seen - at
            if not need(size + 1):
                raise ValueError("WARC file ends within a header")
            seen = at + back
        head = bytes(held[at:end]).lower()
        if not head.startswith(b"warc/"):
            raise ValueError("not a WARC record")
        length = next(int(x.partition(b":")[2]) for x in head.split(b"\r\n") if x.startswith(b"content-length:"))
        size = end - at + 4 + length + 4
        if not need(size):
            raise ValueError("WARC file ends within a record")
        yield bytes(held[at : at + size])
        at += size


def parse_files(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """record of every record of the WARC files in `paths` (path), which may be gzipped; a task reads a file as a stream."""

    def run(batches):
        from pyarrow import fs

        for b in batches:
            for path in b.column("path").to_pylist():
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_stream(at, compression=None) as f:
                    batch, held = [], 0
                    for record in records_in(members(f, path.endswith(".gz"))):
                        batch.append(record)
                        held += len(record)
                        if held >= 8_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array(batch, pa.binary())], names=["record"])
                            batch, held = [], 0
                    if batch:
                        yield pa.RecordBatch.from_arrays([pa.array(batch, pa.binary())], names=["record"])

    return paths.select("path").repartition(common.partitions(spark), "path").mapInArrow(run, "record binary")


def store_records(records: DataFrame, folder: str) -> Archive:
    """An archive of records that exist already (record): the bytes before the payload are kept exactly, equal payloads once. A record without an HTTP header has its whole block as payload."""
    text = F.substring_index(F.col("record").cast("string"), END, 1)
    split = records.select("record", (F.octet_length(text) + F.lit(4)).alias("warc"), field(text, "Content-Length").cast("int").alias("size"), field(text, "Content-Type").alias("type"), field(text, "WARC-Type").alias("kind"))
    http = F.octet_length(F.substring_index(F.substring(F.col("record"), F.col("warc") + F.lit(1), F.col("size")).cast("string"), END, 1)) + F.lit(4)
    at = F.col("warc") + F.when(F.col("kind") == "revisit", F.col("size")).when(F.lower("type").startswith("application/http"), F.least(http, F.col("size"))).otherwise(F.lit(0))
    split = split.withColumn("at", at)
    payload = F.substring(F.col("record"), F.col("at") + F.lit(1), F.col("warc") + F.col("size") - F.col("at"))
    rows = split.select(F.unhex(F.sha2(payload, 256)).alias("key"), F.substring(F.col("record"), F.lit(1), F.col("at")).alias("head"), payload.alias("payload"), F.col("kind"))
    marked = common.save(rows.select("key", "head", F.monotonically_increasing_id().alias("row"), (F.coalesce("kind", F.lit("")) == "revisit").alias("bare")), f"{folder}/facts")
    top = marked.where("NOT bare").groupBy("key").agg(F.min("row").alias("row")).withColumn("is_first", F.lit(True))
    heads = marked.join(top, ["key", "row"], "left").select("key", F.coalesce("is_first", F.lit(False)).alias("is_first"), "head")
    return store(heads, rows.where("coalesce(kind, '') <> 'revisit'").select("key", "payload"), folder)


#: The same records by DuckDB: html is the payload, its equals are found as they are.
SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS s, max(page_id) OVER (PARTITION BY h) AS top FROM p),
v AS (SELECT *, [('0x' || substr(s, 5 * i + 1, 5))::INTEGER FOR i IN range(8)] AS v FROM d)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string([substr('{BASE32}', (x >> 15) + 1, 1) || substr('{BASE32}', ((x >> 10) & 31) + 1, 1) || substr('{BASE32}', ((x >> 5) & 31) + 1, 1) || substr('{BASE32}', (x & 31) + 1, 1) FOR x IN v], '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM v
"""
