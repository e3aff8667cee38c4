"""WARC archives: exact round trips, and archives that must be refused."""

import base64
import gzip
import hashlib
import random

import pytest
from conftest import fails
from pyspark.sql import functions as F

from vectext.llm import warc


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@pytest.mark.parametrize("payload", [
    b"", b"a", b"WARC/1.1", b"\r\n\r\nWARC/1.1\r\n" * 5, b"WARC/1.WARC/1.1", b"0\r\n\r\n", b"x" * 100, bytes(range(256)) * 3,
])
@pytest.mark.parametrize("size", [1, 7, 9, 1 << 16])
def test_chunks(payload, size):
    body = b"".join(warc.to_chunks(payload, size))
    assert warc.from_chunks(body) == payload and warc.VERSION not in body
    assert warc.http_payload(warc.HTTP_HEAD + body) == payload


def test_foreign_chunks():
    assert warc.from_chunks(b"3;a=b\r\nabc\r\n0A\r\n0123456789\r\n0\r\nTrailer: x\r\n\r\n") == b"abc0123456789"
    for bad in (b"", b"3\r\nabcd\r\n0\r\n\r\n", b"x\r\n", b"3\r\nabc\r\n", b"0\r\n", b"5\r\nabc"):
        with pytest.raises(ValueError):
            warc.from_chunks(bad)
    assert warc.http_payload(b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n3\r\nabc") == b"3\r\nabc"


def test_segments():
    assert warc.join_segments([(2, b"b"), (1, b"a"), (3, b"c")], 3) == b"abc"
    for parts, total in (([(2, b"b")], None), ([(1, b"a"), (3, b"c")], 2), ([(1, b"a"), (1, b"a")], 2), ([(1, b"a"), (2, b"b")], 3), ([(1, b"a"), (2, b"b")], None)):
        with pytest.raises(ValueError):
            warc.join_segments(parts, total)


def test_base32(spark):
    texts = ["", "abc", "é"] + [str(k) for k in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", warc.base32(F.sha1("t")).alias("d"))
    assert all(r["d"] == digest(r["t"].encode()) for r in df.collect())


LONG = "".join(random.Random(1).choices("ab\r\n é<>WARC/1.1", k=40_000))
ROWS = [
    (1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>two</p>"), (3, "http://a/3", "<p>one</p>"), (9, None, "<p>one</p>"),
    (4, "http://a b\r\nX: y/é", ""), (5, "", None), (6, "u", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"), (7, "u", LONG), (8, "u", LONG),
    (10, "u", " \r\n"), (None, "u", "nobody"), (None, "u", "two of us"), (11, "v", "two of us"), (12, "u", "é 中 \U0001f600 \x00"),
    (13, "r", "again"), (13, "r", "again"), (13, "s", "again"), (14, "u", "\r\n\r\n"), (15, "u WARC/1.1", "WARC/1.1\r\n"),
]


def plain(rows, least=0):
    groups, out = {}, []
    for page_id, url, html in rows:
        payload = (html or "").encode()
        groups.setdefault(payload, []).append((page_id, warc.url_header(url) if url is not None else None))
    for payload, members in groups.items():
        members.sort(key=lambda m: (m[0] is not None, m[0] or 0, m[1] is not None, m[1] or ""))
        for k, (page_id, url) in enumerate(members):
            first = k == len(members) - 1 or len(payload) < least
            out.append((page_id, url, len(payload), digest(payload), "response" if first else "revisit", None if first else members[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("segment_bytes, least", [(64, 0), (1000, 8), (1 << 20, 1 << 30)])
def test_round_trip(spark, tmp_path, segment_bytes, least):
    df = spark.createDataFrame(ROWS, "page_id bigint, url string, html string").repartition(4)
    df = df.withColumn("record", F.lit("x")).withColumn("n", F.lit(0)).withColumn("class", F.lit("x"))
    out = f"{tmp_path}/warc"
    warc.write_archives(df, out, segment_bytes=segment_bytes, least_bytes=least, records_per_file=7)
    got = warc.read_archives(spark, out, payloads=True).collect()
    found = sorted((tuple(r)[:6] for r in got), key=repr)
    assert found == plain(ROWS, least)
    for r in got:
        if r["record_type"] == "response":
            assert digest(bytes(r["payload"])) == r["payload_digest"] and len(r["payload"]) == r["payload_bytes"]
        else:
            assert r["payload"] is None
    texts = {bytes(r["payload"]) for r in got if r["payload"] is not None}
    assert texts == {(html or "").encode() for _, _, html in ROWS}
    records = warc.read_records(spark, out)
    assert records.agg(F.max(F.octet_length("block"))).first()[0] <= max(segment_bytes, len(warc.HTTP_HEAD))
    parts = records.where("kind = 'continuation'")
    assert (parts.count() > 0) == (segment_bytes < 1 << 20)
    assert records.select("record").distinct().count() == records.count()


def test_files_are_warc(spark, tmp_path):
    """A plain reader that goes by lengths alone finds the same records."""
    df = spark.createDataFrame(ROWS, "page_id bigint, url string, html string")
    out = f"{tmp_path}/warc"
    warc.write_archives(df, out, segment_bytes=500)
    kinds = []
    for file in sorted(tmp_path.glob("warc/part-*")):
        data, at = gzip.open(file).read(), 0
        while at < len(data):
            end = data.index(b"\r\n\r\n", at)
            lines = data[at:end].decode().split("\r\n")
            assert lines[0] == "WARC/1.1"
            fields = dict(line.split(": ", 1) for line in lines[1:])
            at = end + 4 + int(fields["Content-Length"])
            assert data[at:at + 4] == b"\r\n\r\n"
            kinds.append(fields["WARC-Type"])
            at += 4
    counts = {r["kind"]: r["count"] for r in warc.read_records(spark, out).groupBy("kind").count().collect()}
    assert {k: kinds.count(k) for k in set(kinds)} == counts


def archive(tmp_path, *records):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc").write_bytes(b"".join(r + b"\r\n\r\n" for r in records))
    return f"{tmp_path}/in"


def test_foreign_archive(spark, tmp_path):
    """Uncompressed, with folded header lines, other kinds of records, and segments out of order."""
    body = b"HTTP/1.1 200 OK\r\n\r\nabcdef"
    part = lambda n, block, *more: warc.record_bytes([
        "WARC-Type: continuation", f"WARC-Record-ID: <c{n}>", "warc-segment-origin-id: <o>", f"WARC-Segment-Number: {n}", *more], block)
    path = archive(
        tmp_path, warc.record_bytes(["WARC-Type: warcinfo", "WARC-Record-ID: <w>"], b"software: x"),
        part(3, body[22:], f"WARC-Segment-Total-Length: {len(body)}"), part(2, body[10:22]),
        warc.record_bytes(["WARC-Type: response", "WARC-Record-ID: <o>", "WARC-Target-URI:\r\n http://x", "WARC-Segment-Number: 1"], body[:10]),
        warc.record_bytes(["WARC-Type: response", "WARC-Record-ID: <p>"], b"HTTP/1.1 200 OK\r\n\r\n"),
    )
    got = warc.read_archives(spark, path, payloads=True).orderBy("payload_bytes").collect()
    assert [(r["url"], bytes(r["payload"])) for r in got] == [(None, b""), ("http://x", b"abcdef")]


def test_refused(spark, tmp_path):
    def of(name, *records):
        (tmp_path / name).mkdir()
        return warc.read_archives(spark, archive(tmp_path / name, *records), payloads=True)

    response = lambda *more: warc.record_bytes(["WARC-Type: response", "WARC-Record-ID: <r>", *more], b"HTTP/1.1 200 OK\r\n\r\nab")
    fails(of("digest", response("WARC-Payload-Digest: sha1:" + "A" * 32)), "does not have its digest")
    fails(of("length", response()[:-1]), "bytes in its block")
    fails(of("gap", response("WARC-Segment-Number: 2")), "are not 1, 2")
    fails(of("total", response("WARC-Segment-Number: 1", "WARC-Segment-Total-Length: 4")), "in total, not 4")
    fails(of("target", warc.record_bytes(["WARC-Type: revisit", "WARC-Record-ID: <v>", "WARC-Refers-To: <r>"], b"")), "is not there")


def test_many_records(spark, tmp_path):
    """Records of all lengths, so that marks lie anywhere in the reader's buffers; a hot payload."""
    df = spark.range(20_000).select(
        F.col("id").alias("page_id"), F.lit("u").alias("url"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.repeat(F.lit("ab\r\n"), (F.col("id") % 97).cast("int"))).alias("html"),
    )
    warc.write_archives(df, f"{tmp_path}/warc")
    got = warc.read_archives(spark, f"{tmp_path}/warc")
    assert got.count() == 20_000 and got.where("record_type = 'response'").count() == 98
    assert got.where("record_type = 'revisit' and refers_to <= page_id").count() == 0


def test_empty_table(spark, tmp_path):
    none = spark.createDataFrame([], "page_id bigint, url string, html string")
    warc.write_archives(none, f"{tmp_path}/warc")
    assert warc.read_archives(spark, f"{tmp_path}/warc").count() == 0
