"""WARC records in segments, and their reassembly.

A record too long for a file is split: the first segment is a `response`
record with segment number 1, the others are `continuation` records that name
it as their origin; the last one carries the total length. Reassembly groups by
origin, orders by segment number, verifies that the segments are complete and
that their lengths add up, and decodes the HTTP response within, whose body
may be in chunked transfer framing.
"""

from __future__ import annotations

import gzip
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

RECORD = pa.schema([
    ("record_id", pa.string()), ("warc_type", pa.string()), ("target_uri", pa.string()), ("origin_id", pa.string()),
    ("segment_number", pa.int32()), ("total_length", pa.int64()), ("payload", pa.binary()),
])
RECORD_SQL = "record_id string, warc_type string, target_uri string, origin_id string, segment_number int, total_length bigint, payload binary"
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def frame(body: bytes, size: int) -> bytes:
    """Chunked transfer framing with chunks of `size` bytes."""
    parts = []
    for i in range(0, len(body), size):
        c = body[i : i + size]
        parts += [b"%x\r\n" % len(c), c, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unframe(data: bytes) -> bytes | None:
    """The body under chunked framing, trailers and chunk extensions ignored; None if the framing is broken."""
    out, at = [], 0
    while True:
        eol = data.find(b"\r\n", at)
        if eol < 0:
            return None
        digits = data[at:eol].split(b";", 1)[0].strip()
        if not digits or len(digits) > 15 or any(c not in b"0123456789abcdefABCDEF" for c in digits):
            return None
        size, at = int(digits, 16), eol + 2
        if size == 0:
            while True:  # trailers, then an empty line that ends the data
                eol = data.find(b"\r\n", at)
                if eol < 0:
                    return None
                if eol == at:
                    return b"".join(out) if eol + 2 == len(data) else None
                at = eol + 2
        if data[at + size : at + size + 2] != b"\r\n":
            return None
        out.append(data[at : at + size])
        at += size + 2


def body_of(response: bytes) -> tuple[str, bytes | None]:
    """Status and body of an HTTP response."""
    cut = response.find(b"\r\n\r\n")
    if cut < 0 or not response.startswith(b"HTTP/"):
        return "bad_http", None
    head, body = response[:cut].lower(), response[cut + 4 :]
    if b"\r\ntransfer-encoding: chunked" in head:
        body = unframe(body)
        return ("ok", body) if body is not None else ("bad_framing", None)
    return "ok", body


def records(pages: DataFrame, segment_bytes: int = 1024) -> DataFrame:
    """WARC records of pages (page_id, url, html): each page a chunked HTTP response, in segments of `segment_bytes`.

    A null html gives an empty body; rows without page_id are left out; rows that
    repeat a page_id are captures of their own, which their record ids number. An
    empty table gives no records; other columns are ignored.
    """

    def split(batches):
        for b in batches:
            out = [[] for _ in RECORD]
            for page, url, html, capture in zip(*(c.to_pylist() for c in b.columns)):
                body = HEAD + frame((html or "").encode(), 512 + page % 1024)
                n = max(1, -(-len(body) // segment_bytes))
                first = f"<urn:page:{page}:{capture}:1>"
                for k in range(n):
                    row = (
                        f"<urn:page:{page}:{capture}:{k + 1}>", "response" if k == 0 else "continuation", url, None if k == 0 else first,
                        k + 1 if n > 1 else None, len(body) if k == n - 1 and n > 1 else None, body[k * segment_bytes : (k + 1) * segment_bytes],
                    )
                    for col, v in zip(out, row):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, RECORD)], schema=RECORD)

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html").where("page_id IS NOT NULL")
    if rows.groupBy("page_id").count().where("count > 1").limit(1).count():
        rows = common.materialise(rows.withColumn("capture", F.monotonically_increasing_id()), "captures")
    else:
        rows = rows.withColumn("capture", F.lit(0).cast("bigint"))
    return rows.mapInArrow(split, RECORD_SQL)


def read_bytes(data: bytes) -> list[tuple]:
    """Rows of RECORD from the bytes of a WARC file, plain or with each record compressed by itself (gzip members).

    A record is a version line, named fields up to an empty line, and a block of as
    many bytes as Content-Length says. Folded field lines are joined; names are case
    insensitive; the block of records other than responses and continuations is kept
    as it is. Reading ends at the first place that doesn't begin a record.
    """
    if data[:2] == b"\x1f\x8b":
        out, left = [], data
        while left:
            d = zlib.decompressobj(31)
            try:
                out.append(d.decompress(left))
            except zlib.error:
                break
            left = d.unused_data
        data = b"".join(out)
    rows, at = [], 0
    while data.startswith(b"WARC/", at):
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            break
        head = re.sub(rb"\r\n[ \t]+", b" ", data[at:end]).split(b"\r\n")[1:]
        field = {k.strip().lower(): v.strip().decode("utf-8", "replace") for k, _, v in (x.partition(b":") for x in head)}
        number = lambda name: int(field[name]) if field.get(name, "").isdigit() else None  # noqa: B023, E731
        size = number(b"content-length")
        if size is None or end + 4 + size > len(data):
            break
        rows.append((
            field.get(b"warc-record-id"), field.get(b"warc-type"), field.get(b"warc-target-uri"), field.get(b"warc-segment-origin-id"),
            number(b"warc-segment-number"), number(b"warc-segment-total-length"), data[end + 4 : end + 4 + size],
        ))
        at = end + 4 + size
        while data[at : at + 2] == b"\r\n":
            at += 2
    return rows


def write_bytes(rows: list[tuple], compress: bool = False) -> bytes:
    """A WARC file of rows of RECORD."""
    out = []
    for ident, kind, uri, origin, number, total, payload in rows:
        named = (("WARC-Record-ID", ident), ("WARC-Type", kind), ("WARC-Target-URI", uri), ("WARC-Segment-Origin-ID", origin), ("WARC-Segment-Number", number), ("WARC-Segment-Total-Length", total), ("Content-Length", len(payload or b"")))
        raw = b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in named if v is not None) + b"\r\n" + (payload or b"") + b"\r\n\r\n"
        out.append(gzip.compress(raw, mtime=0) if compress else raw)
    return b"".join(out)


def read_files(spark, path: str) -> DataFrame:
    """Records of all WARC files under a path, a task for each few files; segments of one record may lie in several of them."""

    def run(batches):
        for b in batches:
            for content in b.column(0):
                rows = read_bytes(content.as_buffer().to_pybytes())
                for k in range(0, len(rows), 1000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[k : k + 1000]), RECORD)], schema=RECORD)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD_SQL)


_OUT = pa.schema([("record_id", pa.string()), ("target_uri", pa.string()), ("segments", pa.int32()), ("length", pa.int64()), ("status", pa.string()), ("body", pa.string())])


def assemble(numbers: list, totals: list, payloads: list) -> tuple[int, int, str, bytes | None]:
    """(segments, length, status, body) of one record's segments, ordered by number then payload."""
    seen: dict[int, bytes] = {}
    told = set()
    for k, t, p in zip(numbers, totals, payloads):
        k = 1 if k is None else k
        if t is not None:
            told.add((k, t))
        if k in seen:
            if seen[k] != p:
                return len(seen), sum(map(len, seen.values())), "conflict", None
            continue
        seen[k] = p or b""
    n, length = len(seen), sum(map(len, seen.values()))
    if min(seen) != 1 or max(seen) != n:
        return n, length, "missing_segment", None
    if n > 1 or numbers[0] is not None:
        if not told:
            return n, length, "missing_segment", None  # the last segment carries the total
        if told != {(n, length)}:
            return n, length, "length_mismatch", None
    return n, length, *body_of(b"".join(seen[k] for k in range(1, n + 1)))


def reassemble(records: DataFrame) -> DataFrame:
    """(record_id, target_uri, segments, length, status, body) of each segmented or whole record.

    status is `ok`, or why there is no body: `missing_segment`, `length_mismatch`
    (the total that the last segment states isn't the sum), `conflict` (two
    different segments with one number), `bad_http`, `bad_framing`, `bad_text`
    (not UTF-8). Repeated equal segments count once; a null payload is empty; a
    missing segment number is 1; continuations whose first segment is missing are
    told under their origin. Records without any id are left out. Payloads are
    shuffled once, by origin, and each task streams through its sorted segments,
    so a record of many segments needs memory for itself alone.
    """
    rows = records.select(
        F.coalesce("origin_id", "record_id").alias("origin"), "segment_number", "total_length", "payload", "target_uri"
    ).where("origin IS NOT NULL")
    parts = common.parts_for(rows, 64 << 20)
    rows = rows.repartition(parts, "origin").sortWithinPartitions("origin", F.coalesce("segment_number", F.lit(1)), "payload")

    def stream(batches):
        open_, out = None, []

        def close():
            if open_:
                n, length, status, body = assemble(open_[2], open_[3], open_[4])
                try:
                    text = None if body is None else body.decode()
                except UnicodeDecodeError:
                    status, text = "bad_text", None
                out.append((open_[0], open_[1], n, length, status, text))

        def flush():
            b = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _OUT)], schema=_OUT)
            out.clear()
            return b

        for b in batches:
            for origin, k, t, p, uri in zip(*(c.to_pylist() for c in b.columns)):
                if open_ is None or open_[0] != origin:
                    close()
                    open_ = [origin, uri, [], [], []]
                if open_[1] is None:
                    open_[1] = uri
                open_[2].append(k)
                open_[3].append(t)
                open_[4].append(p)
            if len(out) >= 1000:
                yield flush()
        close()
        if out:
            yield flush()

    return rows.mapInArrow(stream, "record_id string, target_uri string, segments int, length bigint, status string, body string")


def pages_from_records(records: DataFrame) -> DataFrame:
    """(page_id, url, status, html) of the records that `records` makes, a row for each page it was given.

    status and html are those of `reassemble`; records of other origins have a null
    page_id; an empty table gives no rows.
    """
    return reassemble(records).select(F.expr(r"nullif(regexp_extract(record_id, 'page:(-?[0-9]+):', 1), '')").cast("bigint").alias("page_id"), F.col("target_uri").alias("url"), "status", F.col("body").alias("html"))


SQL = "SELECT page_id, url, 'ok' AS status, coalesce(html, '') AS html FROM pages WHERE page_id IS NOT NULL"
