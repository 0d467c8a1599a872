import base64
import gzip
import hashlib

import pytest
from pyspark.errors import PySparkException

from codeatlas import scratch
from codeatlas.llm import registry, warc
from oracle import compare

SCHEMA = "page_id long, url string, html string"


def brute(rows, least=0):
    """(page_id, bytes, digest, type, refers_to) of each row; page_ids differ."""
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        same = [j for j, _, h in rows if (h or "") == (html or "")]
        top = max(same, key=lambda j: -1 if j is None else j)
        first = i == top or len(data) < least
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first else "revisit", None if first else top))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


ROWS = [
    (1, "http://a/", "same"), (7, "http://b/\r\nWARC-Type: evil", "same"), (3, None, "same"), (4, "http://c/", None), (5, "http://d/", ""),
    (6, "http://e/", "hé€\U0001f600\r\n\r\nWARC/1.1\r\n"), (8, "http://f/", "x" * 300_000), (None, "http://g/", "alone"), (9, "http://g/", "Content-Length: 0\r\n\r\n"),
]


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert compare(spark, "op12_warc", registry.op12_warc, registry.oracle_sql()["op12_warc"], sf) == 50


@pytest.mark.parametrize("least", [0, 1, 5, 10**6])
def test_records_equal_brute_force(spark, least):
    df = spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "1 AS key", "'x' AS head", "2 AS row")
    assert got(warc.archived(df, least)) == brute(ROWS, least)


def test_empty_table(spark):
    assert got(warc.archived(spark.createDataFrame([], SCHEMA))) == []


def test_repeated_rows_each_give_a_record(spark):
    rows = got(warc.archived(spark.createDataFrame([(1, "u", "a")] * 3 + [(None, "u", "a")] * 2, SCHEMA)))
    assert [r[3] for r in rows].count("response") == 1 and len(rows) == 5
    assert {r[4] for r in rows if r[3] == "revisit"} == {1}


def test_payloads_are_stored_once_and_records_are_exact(spark):
    folder = scratch.folder(spark)
    archive = warc.write(spark.createDataFrame(ROWS, SCHEMA), folder)
    assert archive.payloads.count() == len({h or "" for _, _, h in ROWS})
    records = [r["record"] for r in warc.restore(archive).collect()]
    assert len(records) == len(ROWS)
    for r in records:
        head, _, rest = bytes(r).partition(b"\r\n\r\n")
        fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        assert len(rest) == int(fields[b"Content-Length"]) + 4 and rest.endswith(b"\r\n\r\n")
        http, _, payload = rest[:-4].partition(b"\r\n\r\n")
        if fields[b"WARC-Type"] == b"response":
            assert fields[b"WARC-Payload-Digest"] == b"sha1:" + base64.b32encode(hashlib.sha1(payload).digest())
            assert f"Content-Length: {len(payload)}".encode() in http
        else:
            assert payload == b"" and b"WARC-Refers-To" in fields
    plan = warc.restore_first(archive)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan


def test_damaged_payload_is_an_error(spark):
    folder = scratch.folder(spark)
    archive = warc.write(spark.createDataFrame(ROWS, SCHEMA), folder)
    archive.payloads = archive.payloads.selectExpr("key", "encode(concat(decode(payload, 'UTF-8'), '!'), 'UTF-8') AS payload")
    with pytest.raises(PySparkException):
        warc.describe(archive, folder).collect()


def test_files_round_trip(spark):
    """Records written to files, read, archived and restored are the same bytes, and gzip reads the files, too."""
    folder = scratch.folder(spark)
    records = warc.restore(warc.write(spark.createDataFrame(ROWS, SCHEMA), folder))
    want = sorted(bytes(r["record"]) for r in records.collect())
    listed = warc.export_files(records, f"{folder}/files", file_bytes=400)
    paths = listed.selectExpr("concat('file://', path) AS path").distinct()
    assert sorted(bytes(r["record"]) for r in warc.parse_files(spark, paths).collect()) == want
    names = [r["path"].removeprefix("file://") for r in paths.collect()]
    assert len(b"".join(gzip.open(p).read() for p in names)) == sum(map(len, want))
    again = warc.store_records(warc.parse_files(spark, paths), f"{folder}/again")
    assert sorted(bytes(r["record"]) for r in warc.restore(again).collect()) == want


def test_foreign_records(spark):
    """Records without HTTP, without digests, and with equal payloads come back byte by byte."""
    one = lambda kind, extra, block: f"WARC/1.0\r\nWARC-Type: {kind}\r\n{extra}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    held = [
        one("warcinfo", "", b"software: x\r\n"), one("response", "Content-Type: application/http; msgtype=response\r\n", b"HTTP/1.0 200 OK\r\nA: b\r\n\r\n\xff\x00body"),
        one("resource", "content-type: text/plain\r\n", b"\xff\x00body"), one("resource", "", b"\xff\x00body"), one("metadata", "", b""), one("revisit", "Content-Type: application/http\r\n", b"HTTP/1.0 200 OK\r\n\r\n"),
    ]
    df = spark.createDataFrame([(bytearray(r),) for r in held], "record binary")
    archive = warc.store_records(df, scratch.folder(spark))
    assert sorted(bytes(r["record"]) for r in warc.restore(archive).collect()) == sorted(held)
    assert archive.payloads.count() == 3


def test_cut_files_are_errors():
    with pytest.raises(ValueError):
        list(warc.records_in(iter([b"WARC/1.0\r\nContent-Length: 5\r\n\r\nab"])))
    with pytest.raises(ValueError):
        list(warc.records_in(iter([b"WARC/1.0\r\nContent-"])))
    pieces = (bytes([b]) for b in b"WARC/1.0\r\nContent-Length: 2\r\n\r\nab\r\n\r\n" * 3)
    assert len(list(warc.records_in(pieces))) == 3
