"""WARC archives: written with segments, chunked framing and revisits, read back whole.

Writing. Rows with equal payloads become one ``response`` record, that of the
largest id, and ``revisit`` records which name it. Equal means equal in SHA-256
of the payload; each distinct payload is shuffled once per input split, so
copies that fill a third of a table collapse before the shuffle, and the other
rows travel without their payload. A response holds an HTTP message in chunked
transfer framing. A message longer than ``segment_bytes`` is cut into segments:
the ``response`` record has number 1, ``continuation`` records carry the
origin's record id and their number, the last one the total length. Files are
written by Spark's text writer, whose lines are whole records, so any store it
reaches will do and lost tasks leave nothing behind.

Reading. The line separator is a record's first line, ``WARC/1.1\\r\\n``. The writer
ends a chunk inside every ``WARC/1.1`` of a payload, so the line never occurs in
one; in an archive from elsewhere where it does, a record's block is not as long
as its header says, which is an error, never a wrong row. Segments
are grouped by their origin's id, put in the order of their numbers and joined;
gaps, repeated numbers, a wrong total length, broken framing and a payload that
does not have its digest are errors. Only records that are segments are shuffled.

Null payloads are empty ones. Null urls and ids have no header and read as null;
a null id loses to any other. White space and control characters of a url are
percent-encoded, as its header asks for; ids come back as they were. Of rows
repeated in all columns one is the response and the others revisit it. A payload
of any length that a Spark value can hold is read and written in segments. An
empty table gives archives without records. Other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vectext.operators.lookups import lookup_join
from vectext.session import cut_lineage

VERSION = b"WARC/1.1"
#: Begins a record. Its first letter does not come again in it, so no reader can miss it at a buffer's end.
MARK = VERSION + b"\r\n"
#: Ends a record.
END = b"\r\n\r\n"
SEGMENT_BYTES = 1 << 20
CHUNK_BYTES = 1 << 16
RECORDS_PER_FILE = 20_000
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nTransfer-Encoding: chunked\r\n\r\n"
#: Digits of base 32 in the notation of numbers, and in that of digests.
DIGITS, LETTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Rows of which a task holds the records at a time.
SLICE_ROWS = 64


# ------------------------------------------------------------------- framing


def to_chunks(payload: bytes, size: int = CHUNK_BYTES) -> Iterator[bytes]:
    """Chunked transfer framing; a chunk ends inside each version mark of the payload."""
    at = 0
    while at < len(payload):
        end = min(at + size, len(payload))
        found = payload.find(VERSION, at, end + len(VERSION) - 1)
        if found >= 0:
            end = min(end, found + 4)
        yield b"%x\r\n%b\r\n" % (end - at, payload[at:end])
        at = end
    yield b"0\r\n\r\n"


def from_chunks(body: bytes) -> bytes:
    """The payload of a chunked body; trailers are skipped, extensions of a size line ignored."""
    parts, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        digits = body[at:line].split(b";", 1)[0].strip() if line >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]+", digits):
            raise ValueError("a chunk has no size")
        size, at = int(digits, 16), line + 2
        if size == 0:
            if not (body.startswith(b"\r\n", at) or body.endswith(b"\r\n\r\n")):
                raise ValueError("the last chunk is not closed")
            return b"".join(parts)
        if body[at + size:at + size + 2] != b"\r\n":
            raise ValueError("a chunk is not as long as it says")
        parts.append(body[at:at + size])
        at += size + 2


def http_payload(message: bytes) -> bytes:
    """The payload of an HTTP message, without its transfer framing."""
    head, gap, body = message.partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("a response has no HTTP head")
    chunked = re.search(rb"(?im)^transfer-encoding:[^\r\n]*\bchunked\b", head)
    return from_chunks(body) if chunked else body


def join_segments(segments: Iterable[tuple[int, bytes]], total: int | None) -> bytes:
    """Blocks in the order of their numbers 1, 2, ...; the total length must be that of the last segment."""
    ordered = sorted(segments, key=lambda s: s[0])
    if [n for n, _ in ordered] != list(range(1, len(ordered) + 1)):
        raise ValueError(f"segments {[n for n, _ in ordered][:20]} are not 1, 2, ...")
    block = b"".join(b for _, b in ordered)
    if len(ordered) > 1 and total is None:
        raise ValueError("the last segment is missing")
    if total is not None and total != len(block):
        raise ValueError(f"segments have {len(block)} bytes in total, not {total}")
    return block


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def base32(hex_digits: Column) -> Column:
    """A hex digest of a multiple of 20 bits, 40 digits here, in base 32."""
    parts = [F.lpad(F.conv(F.substring(hex_digits, k, 5), 16, 32), 4, "0") for k in range(1, 41, 5)]
    return F.translate(F.concat(*parts), DIGITS, LETTERS)


# ------------------------------------------------------------------- writing


def record_id(*parts: Column) -> Column:
    """A record's id, made from what tells it from all others."""
    digits = F.sha2(F.to_json(F.array(*[F.coalesce(p.cast("string"), F.lit("\0")) for p in parts])), 256)
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(digits, a, n) for a, n in cuts]), F.lit(">"))


def url_header(url: str) -> str:
    """A url fit for a header line: white space and control characters percent-encoded, and a point of the mark."""
    encoded = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    return encoded.replace(VERSION.decode(), "WARC/1%2E1")


def head_lines(kind: str, record: str, date: str, id: str | None, url: str | None, *more: str) -> list[str]:
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: {record}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {url_header(url)}")
    if id is not None:
        lines.append(f"X-Row-ID: {quote(id, safe='')}")
    return [*lines, *more]


def record_bytes(lines: Iterable[str], block: bytes) -> bytes:
    """A record but for the two line ends behind it, which the writer adds."""
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}"])
    return MARK + head.encode() + b"\r\n\r\n" + block


def response_records(
    record: str, date: str, id: str | None, url: str | None, payload: bytes, segment_bytes: int
) -> Iterator[bytes]:
    """The ``response`` record of a payload, and its ``continuation`` records."""
    message = HTTP_HEAD + b"".join(to_chunks(payload))
    parts = [message[at:at + segment_bytes] for at in range(0, len(message), segment_bytes)]
    common = [f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", "Content-Type: application/http; msgtype=response"]
    if len(parts) == 1:
        yield record_bytes(head_lines("response", record, date, id, url, *common), message)
        return
    yield record_bytes(head_lines("response", record, date, id, url, *common, "WARC-Segment-Number: 1"), parts[0])
    for n, part in enumerate(parts[1:], 2):
        tail = hashlib.sha256(f"{record} {n}".encode()).hexdigest()
        own = f"<urn:uuid:{tail[:8]}-{tail[8:12]}-{tail[12:16]}-{tail[16:20]}-{tail[20:32]}>"
        more = [f"WARC-Segment-Origin-ID: {record}", f"WARC-Segment-Number: {n}"]
        if n == len(parts):
            more.append(f"WARC-Segment-Total-Length: {len(message)}")
        yield record_bytes(head_lines("continuation", own, date, None, url, *more), part)


def write_archives(
    df: DataFrame, path: str, id: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0,
    date: str = "1970-01-01T00:00:00Z", segment_bytes: int = SEGMENT_BYTES, records_per_file: int = RECORDS_PER_FILE,
) -> None:
    """Writes every row as a record below ``path``.

    Of equal payloads of at least ``least_bytes`` bytes the row of the largest
    id is the response, the others revisit it; smaller ones are all responses.
    """
    rows = df.select(
        F.col(id).cast("string").alias("text_id"), F.col(id).alias("id"), F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("shared", F.octet_length("payload") >= least_bytes)
    content = F.sha2("payload", 256)
    # Small payloads are a class a row, which its id and url tell apart.
    own = F.sha2(F.to_json(F.array(content, F.coalesce("text_id", F.lit("\0")), F.coalesce("url", F.lit("\0")))), 256)
    rows = rows.withColumn("class", F.when(F.col("shared"), content).otherwise(F.concat(F.lit("own "), own)))
    first = F.struct("id", "url", "text_id")

    wide = rows.groupBy("class", "shared").agg(
        F.max(F.struct("id", "url", "text_id", "payload")).alias("row"), F.count("*").alias("n")
    )
    copies = F.sequence(F.lit(1).cast("bigint"), F.when(F.col("shared"), F.lit(1).cast("bigint")).otherwise(F.col("n")))
    responses = wide.select("class", "row.*", F.explode(copies).alias("copy")).select(
        response_id(F.col("class"), F.col("copy")).alias("record"), "text_id", "url", "payload"
    )

    def frame(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                for r in batch.slice(at, SLICE_ROWS).to_pylist():
                    records = response_records(r["record"], date, r["text_id"], r["url"], r["payload"], segment_bytes)
                    yield pa.RecordBatch.from_arrays([pa.array(list(records), pa.binary())], names=["value"])

    # The rows without their payloads: those that are not their class's response revisit it.
    narrow = cut_lineage(
        rows.where("shared").groupBy("class", "id", "url", "text_id", F.sha1("payload").alias("sha1"))
        .agg(F.count("*").alias("n"))
    )
    keepers = narrow.groupBy("class").agg(F.max(first).alias("keeper"), F.sum("n").alias("total")).where("total > 1")
    again = lookup_join(narrow, keepers, "class", ["id", "url"], "inner")
    again = again.withColumn("n", F.col("n") - first.eqNullSafe(F.col("keeper")).cast("bigint")).where("n > 0")
    again = again.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("copy"))

    @F.pandas_udf("binary")
    def revisit_record(record, target, text_id, url, digest):
        import pandas as pd

        return pd.Series([
            record_bytes(head_lines(
                "revisit", own, date, i, u, f"WARC-Refers-To: {origin}", f"WARC-Payload-Digest: sha1:{sha1}",
                "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            ), b"")
            for own, origin, i, u, sha1 in zip(record, target, text_id, url, digest)
        ], dtype=object)

    revisits = again.select(revisit_record(
        record_id(F.lit("revisit"), F.col("class"), F.col("text_id"), F.col("url"), F.col("copy")),
        response_id(F.col("class"), F.lit(1)), F.col("text_id"), F.col("url"), base32(F.col("sha1")),
    ).alias("value"))
    # A string of Spark holds any bytes, and its text writer writes them as they are.
    records = responses.mapInArrow(frame, "value binary").unionByName(revisits).select(F.col("value").cast("string"))
    records.write.option("lineSep", END.decode()).option("compression", "gzip").option(
        "maxRecordsPerFile", records_per_file
    ).text(path)


def response_id(class_: Column, copy: Column) -> Column:
    return record_id(F.lit("response"), class_, copy.cast("bigint"))


# ------------------------------------------------------------------- reading

RECORD = (
    "record string, kind string, text_id string, url string, refers_to string, digest string, origin string, "
    "segment int, total bigint, block binary"
)
RECORD_TYPES = pa.schema([
    *[(c, pa.string()) for c in ("record", "kind", "text_id", "url", "refers_to", "digest", "origin")],
    ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary()),
])


def parse_record(piece: bytes) -> dict | None:
    """Headers and block of what lies between two marks; None of an empty piece."""
    if not piece:
        return None
    head, gap, rest = piece.partition(b"\r\n\r\n")
    fields = {}
    # A line that begins with white space goes on with the line before it.
    for line in re.sub(rb"\r\n[ \t]+", b" ", head).split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            fields[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    if not gap or not length.isdigit():
        raise ValueError("a record has no length")
    block, tail = rest[:int(length)], rest[int(length):]
    if len(block) != int(length) or tail != END:
        raise ValueError(f"record {fields.get('warc-record-id')} has {len(rest)} bytes in its block, not {length}")
    number, total = fields.get("warc-segment-number"), fields.get("warc-segment-total-length")
    row_id = fields.get("x-row-id")
    return {
        "record": fields.get("warc-record-id"), "kind": fields.get("warc-type"),
        "text_id": None if row_id is None else unquote(row_id), "url": fields.get("warc-target-uri"),
        "refers_to": fields.get("warc-refers-to"), "digest": fields.get("warc-payload-digest"),
        "origin": fields.get("warc-segment-origin-id"), "segment": None if number is None else int(number),
        "total": None if total is None else int(total), "block": block,
    }


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives below ``path``: its header fields and its block."""
    pieces = spark.read.option("lineSep", MARK.decode()).text(path).select(F.col("value").cast("binary"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                found = [parse_record(p.as_buffer().to_pybytes()) for p in batch.slice(at, SLICE_ROWS).column(0)]
                yield pa.RecordBatch.from_pylist([r for r in found if r is not None], schema=RECORD_TYPES)

    return pieces.mapInArrow(parse, RECORD)


def reassembled(records: DataFrame, payloads: bool = True) -> DataFrame:
    """``record, text_id, url, payload_bytes, payload_digest`` (and ``payload``) of every response.

    Records that are no segments are decoded where they are; segments meet by
    their origin's id.
    """
    responses = records.where("kind = 'response' and segment is null").select(
        "record", "text_id", "url", "digest", F.col("total"), F.array(F.struct(F.lit(1).alias("segment"), "block")).alias("segments")
    )
    parts = records.where("segment is not null").groupBy(F.coalesce("origin", "record").alias("record")).agg(
        F.max("text_id").alias("text_id"), F.max(F.when(F.col("kind") == "response", F.col("url"))).alias("url"),
        F.max("digest").alias("digest"), F.max("total").alias("total"),
        F.collect_list(F.struct("segment", "block")).alias("segments"),
    )
    columns = [("record", pa.string()), ("text_id", pa.string()), ("url", pa.string()),
               ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
    if payloads:
        columns.append(("payload", pa.binary()))
    types = pa.schema(columns)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                out = []
                for r in batch.slice(at, SLICE_ROWS).to_pylist():
                    block = join_segments([(s["segment"], s["block"]) for s in r["segments"]], r["total"])
                    payload = http_payload(block)
                    digest = payload_digest(payload)
                    if (r["digest"] or "").lower().startswith("sha1:") and r["digest"][5:].upper() != digest:
                        raise ValueError(f"the payload of record {r['record']} does not have its digest")
                    out.append({**r, "payload": payload, "payload_bytes": len(payload), "payload_digest": digest})
                yield pa.RecordBatch.from_pylist([{c: r[c] for c in types.names} for r in out], schema=types)

    schema = "record string, text_id string, url string, payload_bytes bigint, payload_digest string"
    return responses.unionByName(parts).mapInArrow(decode, schema + (", payload binary" if payloads else ""))


def read_archives(
    spark: SparkSession, path: str, id: str = "page_id", id_type: str = "bigint", payloads: bool = False
) -> DataFrame:
    """``id, url, payload_bytes, payload_digest, record_type, refers_to`` of every response and revisit.

    ``refers_to`` is the id of the response that a revisit names; length and
    digest of a revisit are those of that response, which must have the digest
    that the revisit gives. With ``payloads`` responses carry their payload.
    """
    records = read_records(spark, path)
    whole = reassembled(records, payloads)
    if not payloads:
        whole = cut_lineage(whole)
    # A record that lies in two archives is one response.
    targets = whole.groupBy("record").agg(F.max(F.struct("text_id", "payload_bytes", "payload_digest")).alias("target"))
    revisits = records.where("kind = 'revisit'").select("text_id", "url", "digest", F.col("refers_to").alias("record"))
    named = lookup_join(revisits, targets, "record", ["text_id", "url"])
    found = F.col("target").isNotNull() & (
        F.col("digest").isNull() | (F.upper("digest") == F.concat(F.lit("SHA1:"), F.col("target.payload_digest")))
    )
    checked = F.when(found, F.col("target.payload_digest")).otherwise(
        F.raise_error(F.concat(F.lit("a revisit's response is not there or another one: "), F.coalesce("record", F.lit("none"))))
    )
    back = named.select(
        F.col("text_id").cast(id_type).alias(id), "url", F.col("target.payload_bytes").alias("payload_bytes"),
        checked.alias("payload_digest"), F.lit("revisit").alias("record_type"),
        F.col("target.text_id").cast(id_type).alias("refers_to"),
        *([F.lit(None).cast("binary").alias("payload")] if payloads else []),
    )
    return whole.select(
        F.col("text_id").cast(id_type).alias(id), "url", "payload_bytes", "payload_digest",
        F.lit("response").alias("record_type"), F.lit(None).cast(id_type).alias("refers_to"),
        *(["payload"] if payloads else []),
    ).unionByName(back)
