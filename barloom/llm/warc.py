"""WARC archives: write with revisits and segments, read back by reassembling them."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Payload bytes that one record holds at most; longer ones continue in further records.
SEGMENT = 1 << 14
#: Records that one file holds at most; with SEGMENT this bounds a file's size, whatever the pages.
RECORDS = 2048
#: Equal payloads of at least this many bytes are stored once.
LEAST = 1000
CRLF = b"\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
#: Bytes per chunk of the transfer framing.
CHUNK = 4096
#: First bytes of a gzip member; bytes that are unpacked at once; the line that opens a record.
GZIP, PIECE, OPENING = b"\x1f\x8b", 1 << 16, re.compile(rb"(?<![^\n])WARC/[0-9.]+\r\n")
CHUNKED, HEX = re.compile(rb"\r\ntransfer-encoding:[^\r\n]*chunked", re.IGNORECASE), re.compile(rb"[0-9A-Fa-f]{1,15}")


def write(pages: DataFrame, path: str, segment: int = SEGMENT, least: int = LEAST) -> None:
    """Writes one response or revisit per row of (page_id, url, html), gzip-compressed, to the folder ``path``.

    The payload is the html in UTF-8, null as empty.  Of equal payloads of at least ``least`` bytes the row with the
    largest page_id is the response (each of them if it is repeated); the others become revisits that refer to it.  A
    payload of more than ``segment`` bytes is framed in chunks and continues in records that name the first one.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    large = F.octet_length("html") >= least
    # short payloads get keys of their own, so that they do not meet in one partition
    rows = rows.withColumn("key", F.when(large, F.sha1(F.col("html").cast("binary"))).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))))
    # combines before the shuffle, so a payload that owns a third of the pages is one row per task
    firsts = rows.where(large).groupBy("key").agg(F.max("page_id").alias("target"), F.count("*").alias("n")).where("n > 1").select("key", "target")
    rows = rows.join(firsts, "key", "left").select("page_id", "url", "html", "target")
    records = rows.mapInArrow(lambda batches: _records(batches, segment), "record binary")
    # the text sink writes the bytes of a value as they are; its line end is the end of a record
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(path)


def _records(batches: Iterator[pa.RecordBatch], segment: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, size = [], 0
        for row in (r for i in range(len(batch)) for r in batch.slice(i, 1).to_pylist()):
            for record in _page(row, segment):
                out.append(record)
                size += len(record)
                if size > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                    out, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])


def _page(row: dict, segment: int) -> Iterator[bytes]:
    payload = row["html"].encode()
    digest = hashlib.sha1(payload).digest()
    page, target = row["page_id"], row["target"]
    name = f"<urn:uuid:{uuid.uuid4()}>"
    headers = {"WARC-Record-ID": name, "WARC-Target-URI": _line(row["url"]), "WARC-Date": "1970-01-01T00:00:00Z", "X-Page-ID": "" if page is None else str(page),
               "WARC-Payload-Digest": "sha1:" + base64.b32encode(digest).decode(), "Content-Type": "application/http; msgtype=response"}
    if target is not None and target != page:
        headers |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "X-Refers-To-Page-ID": str(target), "X-Payload-Length": str(len(payload))}
        yield _record("revisit", headers, HTTP + CRLF)
        return
    if len(payload) <= segment:
        yield _record("response", headers, HTTP + b"Content-Length: %d\r\n\r\n" % len(payload) + payload)
        return
    chunks = [b"%x\r\n%b\r\n" % (len(c), c) for c in (payload[i:i + CHUNK] for i in range(0, len(payload), CHUNK))]
    block = HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + b"".join(chunks) + b"0\r\n\r\n"
    yield _record("response", headers | {"WARC-Segment-Number": "1"}, block[:segment])
    for number, at in enumerate(range(segment, len(block), segment), 2):
        more = {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": headers["WARC-Date"], "WARC-Segment-Origin-ID": name, "WARC-Segment-Number": str(number)}
        if at + segment >= len(block):
            more["WARC-Segment-Total-Length"] = str(len(block))
        yield _record("continuation", more, block[at:at + segment])


def _line(text: str | None) -> str:
    return " ".join((text or "").split())


def _record(kind: str, headers: dict[str, str], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + CRLF + CRLF + block


RECORD = "kind string, page_id bigint, url string, origin string, number int, total bigint, digest string, refers_to bigint, length bigint, cut boolean, block binary"


def records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives in a folder, by their Content-Length; files may be plain or gzip, in any members.

    A file is one row of the scan, so files should be of bounded size, as ``write`` makes them.  A record without a
    readable Content-Length, or whose header has no end, is a row of kind ``damaged`` and nothing else; reading goes on at
    the next line that opens a record.  A record that the file's end cuts off keeps what is there and is ``cut``; so does
    the text of a gzip member that is cut or broken.  A payload digest other than SHA-1 (base 32 or hexadecimal), and
    numbers that are none or too large, are null.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_parse, RECORD)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["kind", "page_id", "url", "origin", "number", "total", "digest", "refers_to", "length", "cut", "block"]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
    for batch in batches:
        for content in batch.column(0):
            rows: list[tuple] = []
            size = 0
            for row in _split(content.as_buffer()):
                rows.append(row)
                size += len(row[-1])
                if size > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def _plain(content: memoryview) -> bytes:
    """The text of a file; members are read piece by piece, so that what follows a member is not copied once per member."""
    if bytes(content[:2]) != GZIP:
        return bytes(content)
    out, at = [], 0
    while at < len(content):
        if bytes(content[at:at + 2]) != GZIP:  # padding or rubbish between members
            piece = bytes(content[at:at + PIECE + 1])
            next_one = piece.find(GZIP)
            at += next_one if next_one >= 0 else PIECE
            continue
        member = zlib.decompressobj(31)
        start = at
        try:
            while not member.eof and at < len(content):
                piece = content[at:at + PIECE]
                out.append(member.decompress(piece))
                at += len(piece)
            at -= len(member.unused_data)
        except zlib.error:
            at = start + 2
    return b"".join(out)


def _split(buffer) -> Iterator[tuple]:
    data = _plain(memoryview(buffer))
    damaged = ("damaged", *[None] * 8, None, b"")
    at = 0
    while opening := OPENING.search(data, at):
        end = data.find(CRLF + CRLF, opening.start())
        follower = OPENING.search(data, opening.end(), end) if end >= 0 else OPENING.search(data, opening.end())
        if follower or end < 0:
            yield damaged
            at = follower.start() if follower else len(data)
            continue
        lines = (x.split(":", 1) for x in data[opening.start():end].decode("utf-8", "replace").split("\r\n")[1:] if ":" in x)
        h = {k.strip().lower(): v.strip() for k, v in lines}
        size = _int(h.get("content-length"))
        if size is None or size < 0:
            yield damaged
            at = end + 2
            continue
        block = data[end + 4:end + 4 + size]
        at = end + 4 + size
        number = _int(h.get("warc-segment-number"), 31)
        origin = h.get("warc-segment-origin-id") or (h.get("warc-record-id") if number is not None else None)
        yield (h.get("warc-type"), _int(h.get("x-page-id")), h.get("warc-target-uri"), origin, number, _int(h.get("warc-segment-total-length")),
               _sha1(h.get("warc-payload-digest", "")), _int(h.get("x-refers-to-page-id")), _int(h.get("x-payload-length")), len(block) < size, block)


def _sha1(text: str) -> str | None:
    """A labelled SHA-1 digest in hexadecimal."""
    label, _, value = text.partition(":")
    if label.lower() != "sha1":
        return None
    if re.fullmatch("[0-9A-Fa-f]{40}", value):
        return value.lower()
    return base64.b32decode(value.upper()).hex() if re.fullmatch("[A-Za-z2-7]{32}", value) else None


def _int(text: str | None, bits: int = 63) -> int | None:
    if not text or not re.fullmatch("[+-]?[0-9]{1,19}", text):
        return None
    value = int(text)
    return value if -(1 << bits) <= value < 1 << bits else None


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per response or revisit: page_id, url, record_type, refers_to, payload, payload_bytes, payload_digest, complete.

    Continuations are grouped by the record they name, ordered by segment number and joined; ``complete`` says that no
    segment is missing, repeated or cut off, that the joined length is the total length of the last segment, and that the
    payload, after the chunked framing is undone, has the digest of the header if that names a SHA-1.  Framing that breaks
    off ends the payload.  Revisits have no payload; their length and digest are those
    of the payload they stand for.  Segments of which the first is missing are left out.  A group holds one page.
    """
    every = records(spark, path)
    single = every.where("number is null and kind in ('response', 'revisit')")
    single = single.select("kind", "page_id", "url", "digest", "refers_to", "length", "block", (~F.col("cut")).alias("whole"))
    parts = every.where("number is not null").groupBy("origin").agg(
        F.sort_array(F.collect_list(F.struct("number", "block"))).alias("parts"), F.max("total").alias("total"), F.max("cut").alias("cut"),
        *[F.max(F.when(F.col("number") == 1, F.col(c))).alias(c) for c in ("kind", "page_id", "url", "digest", "refers_to", "length")])
    parts = parts.withColumn("joined", F.aggregate(F.col("parts.block"), F.lit(b""), lambda a, b: F.concat(a, b))).where("kind is not null").select(
        "kind", "page_id", "url", "digest", "refers_to", "length", F.col("joined").alias("block"),
        (~F.col("cut") & F.array_max("parts.number").eqNullSafe(F.size("parts")) & F.octet_length("joined").eqNullSafe(F.col("total"))).alias("whole"))
    rows = single.unionByName(parts).withColumn("payload", F.when(F.col("kind") == "response", F.arrow_udf(_payload, "binary")("block")))
    own = F.sha1("payload")
    return rows.select(
        "page_id", "url", F.col("kind").alias("record_type"), "refers_to", "payload",
        F.coalesce(F.octet_length("payload").cast("long"), "length").alias("payload_bytes"), F.coalesce(own, "digest").alias("payload_digest"),
        (F.col("whole") & F.coalesce(F.coalesce(own, "digest") == F.col("digest"), F.lit(True))).alias("complete"))


def _payload(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in columns:
        yield pa.array([None if not b.is_valid else _body(b.as_py()) for b in column], pa.binary())


def _body(block: bytes) -> bytes:
    """The payload of an HTTP response; without a header the whole block."""
    head, blank, body = block.partition(CRLF + CRLF)
    if not head.startswith(b"HTTP/") or not blank:
        return block
    if not CHUNKED.search(head):
        return body
    out, at = [], 0
    while (end := body.find(CRLF, at)) >= 0:
        digits = body[at:end].split(b";")[0].strip()
        size = int(digits, 16) if HEX.fullmatch(digits) else 0
        if not size:
            break
        out.append(body[end + 2:end + 2 + size])
        at = end + 4 + size
    return b"".join(out)
