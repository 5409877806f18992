"""Web archives: writing pages as WARC records, and reading archives back with their segments put together.

Files are written by Spark's text writer, whose line separator is the empty lines that end a record, and read as
whole binary files, so both work on any file system of the cluster. An archive file holds
ARCHIVE_BYTES and one record at most, and a record SEGMENT_BYTES and its headers: longer blocks are cut into
segments, which are records of their own and may lie in different files.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm._common import each_copy, text_or_empty, written

SEGMENT_BYTES = 1 << 16
CHUNK_BYTES = 1 << 13
ARCHIVE_BYTES = 32 << 20
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value
_CHUNK_SIZE = re.compile(rb"[ \t]*([0-9A-Fa-f]+)[ \t]*(?:;[^\r\n]*)?\r\n")
_RECORD = "record_id string, record_type string, target string, refers_to string, payload_digest string, payload_bytes long, payload binary, status string"
_SEGMENT = "origin string, number int, record_type string, target string, payload_digest string, total long, block binary"
_WHOLE = "origin string, record_type string, target string, payload_digest string, total long, blocks array<binary>, fault string, copies long"


# ---- writing ---------------------------------------------------------------------------------


def _record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    head = "".join(f"{name}: {value}\r\n" for name, value in [*fields, ("Content-Length", str(len(block)))] if value is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block


def _name(page_id: int | None, digest: str, segment: int = 1) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}{'' if segment == 1 else f':{segment}'}>"


def chunked(payload: bytes, size: int) -> bytes:
    """A payload in chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(payload[i : i + size]), payload[i : i + size]) for i in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def page_records(page_id: int | None, url: str | None, payload: bytes, sha1: str, original: int | None, revisit: bool, date: str, segment: int, chunk: int) -> Iterator[bytes]:
    """The records of one page: a revisit, or a response with its continuations."""
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    target = None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url)
    common = [("WARC-Target-URI", target), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if revisit:
        refers = [("WARC-Profile", PROFILE), ("WARC-Refers-To", _name(original, digest))]
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", _name(page_id, digest)), *refers, *common], head + b"Content-Length: %d\r\n\r\n" % len(payload))
        return
    if len(payload) > chunk:
        block = head + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk)
    else:
        block = head + b"Content-Length: %d\r\n\r\n" % len(payload) + payload
    pieces = [block[i : i + segment] for i in range(0, len(block), segment)]
    first = [("WARC-Type", "response"), ("WARC-Record-ID", _name(page_id, digest)), *common]
    yield _record(first if len(pieces) == 1 else [*first, ("WARC-Segment-Number", "1")], pieces[0])
    for number, piece in enumerate(pieces[1:], 2):
        total = str(len(block)) if number == len(pieces) else None
        fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", _name(page_id, digest, number)), ("WARC-Target-URI", target), ("WARC-Date", date)]
        yield _record([*fields, ("WARC-Segment-Origin-ID", _name(page_id, digest)), ("WARC-Segment-Number", str(number)), ("WARC-Segment-Total-Length", total)], piece)


def _archives(batches: Iterator[pa.RecordBatch], date: str, segment: int, chunk: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Rows of one archive file each: records joined by the separator that the writer puts after the last one."""
    info = _record([("WARC-Type", "warcinfo"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
    held, size = [info], len(info)
    pack = lambda: pa.RecordBatch.from_arrays([pa.array([END.join(held)], pa.binary())], ["archive"])
    for batch in batches:
        for row in zip(*batch.columns):
            for record in page_records(*(x.as_py() for x in row), date, segment, chunk):
                if size + len(record) > limit and len(held) > 1:
                    yield pack()
                    held, size = [info], len(info)
                held.append(record)
                size += len(record) + len(END)
    if len(held) > 1:
        yield pack()


def write_warc(
    pages: DataFrame, path: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES, archive_bytes: int = ARCHIVE_BYTES, compression: str = "gzip",
) -> None:
    """Writes every row of pages (page_id, url, html) as WARC records below path, which must not exist.

    Of rows with equal payloads of min_bytes and up, those with the smallest page_id are responses and the others revisits
    of it; a row without a page_id is a revisit where its group has one with an id, else a response. Rows that repeat the smallest page_id
    are responses each. A null html is an empty payload, a null url gives no target. Payloads over chunk_bytes are
    written in chunked transfer framing and blocks over segment_bytes as segments, so records stay small
    however long a page is. Archives are gzip files, as is usual (compression: gzip or none). An empty table writes no records.

    Rows meet their group's smallest id by a join on the payload's hash. Groups of at least a 4096th of all rows, of
    which there can be no more than 4096, are broadcast, so that no task gets a hot group.
    """
    body = text_or_empty("html").cast("binary")
    rows = pages.select("page_id", "url", body.alias("body")).withColumn("sha1", F.sha1("body"))
    sized = rows.where(F.octet_length("body") >= min_bytes)
    groups = written(sized.groupBy("sha1").agg(F.min("page_id").alias("original"), F.count("*").alias("n")).where("n > 1"), "warc-groups")
    heavy = F.col("n") * 4096 >= pages.count()
    hot = groups.where(heavy).select("sha1", F.col("original").alias("hot_original"), F.lit(True).alias("hot"))
    light = groups.where(~heavy).select(F.col("sha1").alias("key"), F.col("original").alias("light_original"), F.lit(True).alias("light"))
    met = rows.join(F.broadcast(hot), "sha1", "left")
    key = F.when(F.col("hot"), F.concat(F.lit("hot:"), F.sha1(F.concat_ws(":", "page_id", "url")))).otherwise(F.col("sha1"))
    met = met.withColumn("key", key).join(light.hint("shuffle_hash"), "key", "left")
    original = F.coalesce("hot_original", "light_original")
    of_group = (F.col("hot") | F.col("light")) & (F.octet_length("body") >= min_bytes)
    revisit = F.coalesce(of_group & original.isNotNull() & ~F.col("page_id").eqNullSafe(original), F.lit(False))
    typed = met.select("page_id", "url", "body", "sha1", original.alias("original"), revisit.alias("revisit"))
    packed = typed.mapInArrow(lambda x: _archives(x, date, segment_bytes, chunk_bytes, archive_bytes), "archive binary")
    packed.select(F.col("archive").cast("string")).write.option("lineSep", END.decode()).option("maxRecordsPerFile", 1).option("compression", compression).text(path)


# ---- reading ---------------------------------------------------------------------------------


def records(content: bytes) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(fields by lower-case name, block) of each record of an archive; the block is None where it is cut short.

    What is no record is passed over up to the next one, after a pair of no fields and None.
    """
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    at = 0
    while at < len(content):
        end = content.find(END, at) if content.startswith(b"WARC/1.", at) else -1
        fields: dict[str, str] = {}
        if end >= 0:
            lines = re.sub(rb"\r\n[ \t]+", b" ", content[at:end]).decode("utf-8", "replace").split("\r\n")[1:]
            fields = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
        length = fields.get("content-length", "")
        if length.isdecimal() and end + 4 + int(length) <= len(content):
            at = end + 4 + int(length)
            yield fields, content[end + 4 : at]
            at += len(END) if content.startswith(END, at) else 0
            continue
        yield fields, None
        found = content.find(END + b"WARC/1.", at + 1)
        at = len(content) if found < 0 else found + len(END)


def unchunked(body: bytes) -> bytes | None:
    """The payload in a chunked transfer framing; None where the framing is broken."""
    parts, at = [], 0
    while size := _CHUNK_SIZE.match(body, at):
        n, at = int(size.group(1), 16), size.end()
        if n == 0:
            return b"".join(parts)
        if body[at + n : at + n + 2] != b"\r\n":
            return None
        parts.append(body[at : at + n])
        at += n + 2
    return None


def payload_of(block: bytes) -> tuple[bytes | None, int | None, str]:
    """(payload, length that the headers state, status) of an HTTP response block."""
    head, found, body = block.partition(END)
    if not found:
        return None, None, "no_http_headers"
    fields = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in head.decode("latin-1").split("\r\n")[1:])}
    stated = int(fields["content-length"]) if fields.get("content-length", "").isdecimal() else None
    if fields.get("transfer-encoding", "").lower() == "chunked":
        payload = unchunked(body)
        return payload, stated, "whole" if payload is not None else "broken_chunk"
    return body, stated, "whole" if stated in (None, len(body)) else "length_mismatch"


def _read(fields: dict[str, str], block: bytes | None, fault: str | None = None) -> tuple:
    """A row of _RECORD."""
    kind, declared = fields.get("warc-type"), fields.get("warc-payload-digest")
    payload, size, status = None, None, fault or ("whole" if block is not None else "truncated" if fields else "not_a_record")
    if block is not None and fault is None:
        if kind == "revisit":
            _, size, status = payload_of(block)
            status = "revisit" if status != "no_http_headers" else status
        elif kind == "response" and fields.get("content-type", "").startswith("application/http"):
            payload, _, status = payload_of(block)
        else:
            payload = block
    digest = declared
    if payload is not None:
        size, digest = len(payload), "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if status == "whole" and declared and declared.lower().startswith("sha1:") and declared.upper() != digest.upper():
            status = "digest_mismatch"
    return fields.get("warc-record-id"), kind, fields.get("warc-target-uri"), fields.get("warc-refers-to"), digest, size, payload, status


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _grouped(rows: Iterator[tuple], schema: pa.Schema, width: int, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of rows whose column number width holds limit bytes, or one row."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[width] or b"") + 200
        if size > limit:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(name, _ARROW[kind]) for name, kind in (column.split() for column in ddl.split(", "))])


def _whole_records(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    def rows():
        for batch in batches:
            for content in batch.column(0):
                for fields, block in records(content.as_py()):
                    if block is None or "warc-segment-number" not in fields:
                        row = _read(fields, block)
                        yield row if with_payload else (*row[:6], None, row[7])

    yield from _grouped(rows(), _arrow(_RECORD), 6)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for batch in batches:
            for content in batch.column(0):
                for f, block in records(content.as_py()):
                    if block is not None and "warc-segment-number" in f:
                        number = f["warc-segment-number"]
                        total = f.get("warc-segment-total-length", "")
                        origin = f.get("warc-segment-origin-id", f.get("warc-record-id"))
                        first = f.get("warc-type") != "continuation"
                        yield origin, int(number) if number.isdecimal() else None, f.get("warc-type") if first else None, f.get("warc-target-uri"), f.get("warc-payload-digest"), int(total) if total.isdecimal() else None, block

    yield from _grouped(rows(), _arrow(_SEGMENT), 6)


def _joined(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    schema = _arrow(_RECORD).append(pa.field("copies", pa.int64()))

    def rows():
        for batch in batches:
            for cells in zip(*batch.columns):
                origin, kind, target, digest, total, blocks, fault, copies = (x.as_py() for x in cells)
                if fault is None and sum(map(len, blocks)) != total:
                    fault = "length_mismatch"
                fields = {"warc-record-id": origin, "warc-type": kind, "warc-target-uri": target, "warc-payload-digest": digest, "content-type": "application/http"}
                row = _read({k: v for k, v in fields.items() if v is not None}, b"".join(blocks), fault)
                yield *(row if with_payload else (*row[:6], None, row[7])), copies

    yield from _grouped(rows(), schema, 6)


def reassembled(segments: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records whose segments (origin, number, ..., block) lie in segments, put together by origin in order of their numbers.

    Numbers must run from 1 without a hole up to the one segment that states the total length, and that length must be the sum
    of the blocks'; else status says missing_segment, length_mismatch or conflicting_segments (one number with different blocks)
    and there is no payload. Equal segments of one number are copies of a record: they are counted before the
    blocks of an origin meet, so a group holds one record's blocks, and the record is given as often as its rarest segment.
    """
    hashed = segments.withColumn("hash", F.md5("block"))
    head = {c: F.max(c).alias(c) for c in ("record_type", "payload_digest", "total")}
    once = hashed.groupBy("origin", "number").agg(*head.values(), F.min("target").alias("target"), F.any_value("block").alias("block"), F.count("*").alias("copies"), (F.min("hash") != F.max("hash")).alias("differ"))
    parts = F.sort_array(F.collect_list(F.struct("number", "block")))
    ends = F.max(F.when(F.col("total").isNotNull(), F.col("number")))
    complete = (F.min("number") == 1) & (F.count("number") == F.max("number")) & (F.count("*") == F.count("number")) & (ends == F.max("number")) & (F.count("record_type") == 1)
    fault = F.when(F.bool_or("differ"), "conflicting_segments").when(~F.coalesce(complete, F.lit(False)), "missing_segment")
    whole = once.groupBy("origin").agg(*head.values(), F.min("target").alias("target"), parts.alias("parts"), fault.alias("fault"), F.min("copies").alias("copies"))
    listed = whole.select("origin", "record_type", "target", "payload_digest", "total", F.col("parts.block").alias("blocks"), "fault", "copies")
    out = listed.mapInArrow(lambda x: _joined(x, with_payload), f"{_RECORD}, copies long")
    return each_copy(out).drop("copies", "block", "copy")


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Every record of the archives below path, segments put together (see reassembled); continuations are no records of their own.

    record_id, record_type, target, refers_to, payload_digest (computed where there is a payload, else as declared), payload_bytes (of a
    revisit: as its HTTP headers state), payload (null unless with_payload) and status: whole, revisit, or what is wrong:
    truncated, not_a_record, no_http_headers, broken_chunk, length_mismatch, digest_mismatch, missing_segment,
    conflicting_segments. Archives may be gzip files. A task holds one archive file at a time; the files are read once for
    whole records and once for segments, and only segments are shuffled. A folder without records gives an empty table.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    whole = files.mapInArrow(lambda x: _whole_records(x, with_payload), _RECORD)
    return whole.union(reassembled(files.mapInArrow(_segments, _SEGMENT), with_payload))


def dangling(found: DataFrame) -> DataFrame:
    """refers_to of the revisits whose original is not among found, once each."""
    wanted = found.where("record_type = 'revisit'").select("refers_to").distinct()
    return wanted.join(found.where("record_type = 'response' AND status = 'whole'").select(F.col("record_id").alias("refers_to")), "refers_to", "left_anti")
