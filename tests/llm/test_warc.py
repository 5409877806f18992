"""Archives written and read back, segments in any order and file, broken records and odd rows."""

import base64
import gzip
import hashlib
import uuid

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tidemark.llm._common import run_dir
from tidemark.llm.warc import chunked, dangling, page_records, payload_of, read_warc, reassembled, records, unchunked, write_warc

PAGES = "page_id long, url string, html string"
BIG = "".join(f"<p>{i} é中\r\n\r\nWARC/1.1\r\n</p>" for i in range(400))
ROWS = [
    (1, "http://a/1", "<html>one</html>"), (2, "http://a/2", "<html>one</html>"), (3, None, None), (4, "http://a/4", ""), (5, "http://a/ 5\r\nX: y", BIG), (6, "http://a/6", BIG), (7, "http://a/7", "é" * 70),
    (8, "u", "twice"), (8, "u", "twice"), (8, "u", "once"), (9, "u", "twice"), (None, "n", "no id"), (None, "n", "no id"), (None, "n", "<html>one</html>"), (-4, "m", "WARC/1.1\r\n\r\n" * 9), (10, "b", BIG + "!"), (10, "b", BIG + "!"),
]


def sha(text):
    return "sha1:" + base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def plain_way(rows, least):
    first = {}
    for page_id, _, html in rows:
        if page_id is not None:
            first[html or ""] = min(page_id, first.get(html or "", page_id))
    out = []
    for page_id, _, html in rows:
        text = html or ""
        original = first.get(text)
        again = len(text.encode()) >= least and original is not None and page_id != original
        out.append((page_id, len(text.encode()), sha(text), "revisit" if again else "response", original if again else None, None if again else text))
    return sorted(out, key=repr)


def page_of(name):
    part = name and name.split(":")[2]
    return int(part) if part else None


@pytest.mark.parametrize(("segment", "chunk", "archive", "least", "compression"), [(1 << 16, 1 << 13, 1 << 25, 0, "none"), (37, 11, 900, 0, "none"), (500, 64, 4000, 20, "gzip")])
def test_pages_come_back(spark, segment, chunk, archive, least, compression):
    path = f"{run_dir(spark)}/test-{uuid.uuid4().hex}"
    write_warc(spark.createDataFrame([(*r, 1, "x") for r in ROWS], f"{PAGES}, n int, sha1 string").repartition(3), path, least, segment_bytes=segment, chunk_bytes=chunk, archive_bytes=archive, compression=compression)
    found = read_warc(spark, path)
    rows = [r for r in found.collect() if r.record_type != "warcinfo"]
    assert {(r.record_type, r.status) for r in rows} == {("response", "whole"), ("revisit", "revisit")}
    got = [(page_of(r.record_id), r.payload_bytes, r.payload_digest, r.record_type, page_of(r.refers_to), None if r.payload is None else bytes(r.payload).decode()) for r in rows]
    assert sorted(got, key=repr) == plain_way(ROWS, least)
    assert dangling(found).count() == 0
    assert any(r.target == "http://a/%205%0D%0AX:%20y" for r in rows)
    light = read_warc(spark, path, with_payload=False).where("record_type <> 'warcinfo'").collect()
    assert sorted((repr(r.record_id), r.payload_bytes, r.status) for r in light) == sorted((repr(r.record_id), r.payload_bytes, r.status) for r in rows)


def test_hot_group_and_empty_table(spark):
    path = f"{run_dir(spark)}/test-{uuid.uuid4().hex}"
    write_warc(spark.createDataFrame([(i, "u", "same" if i % 3 else f"page {i}") for i in range(3000)], PAGES), path)
    counts = {(r.record_type, r.refers_to): r["count"] for r in read_warc(spark, path, False).where("record_type <> 'warcinfo'").groupBy("record_type", "refers_to").count().collect()}
    assert counts == {("response", None): 1001, ("revisit", f"<urn:page:1:{sha('same')[5:]}>"): 1999}
    write_warc(spark.createDataFrame([], PAGES), path + "-empty")
    assert read_warc(spark, path + "-empty").where("record_type <> 'warcinfo'").count() == 0


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=60), st.integers(1, 20))
def test_chunked_framing(payload, size):
    assert unchunked(chunked(payload, size)) == payload
    assert payload_of(b"HTTP/1.1 200 OK\r\ntransfer-encoding: Chunked\r\n\r\n" + chunked(payload, size)) == (payload, None, "whole")


def test_broken_framing():
    assert unchunked(b"5;a=b\r\nhello\r\n0\r\nTrailer: x\r\n\r\n") == b"hello"
    assert [unchunked(x) for x in (b"", b"5\r\nhell\r\n0\r\n\r\n", b"5\r\nhello0\r\n\r\n", b"zz\r\n", b"5\r\nhello\r\n")] == [None] * 5
    assert payload_of(b"HTTP/1.1 200 OK\r\nContent-Length: 4\r\n\r\nhello") == (b"hello", 4, "length_mismatch")
    assert payload_of(b"no headers")[2] == "no_http_headers"


def test_records_of_a_damaged_archive():
    good = list(page_records(1, "u", b"text", hashlib.sha1(b"text").hexdigest(), None, False, "d", 99, 99))[0] + b"\r\n\r\n"
    cut = good.replace(b"Content-Length: ", b"Content-Length: 9", 1)
    found = list(records(good + b"junk between\r\n\r\n" + good + cut))
    assert [b is None for _, b in found] == [False, True, False, True] and found[1][0] == {} and found[3][0]["warc-type"] == "response"
    assert list(records(gzip.compress(good) + gzip.compress(good))) == list(records(good + good))


def test_segments_without_order_and_with_faults(spark):
    def cut(page_id, text, n=7):
        return [records(x).__next__() for x in page_records(page_id, "u", text.encode(), hashlib.sha1(text.encode()).hexdigest(), None, False, "d", n, 5)]

    rows = []
    for page_id, text, change in [(1, "a text of some length", None), (2, "first goes", 0), (3, "last one goes", -1), (4, "a hole in it", 2), (5, "bytes are lost", "short"), (6, "copies", "copy"), (7, "two versions", "differ"), (8, "wrong bytes", "bad")]:
        made = cut(page_id, text)
        if isinstance(change, int):
            made.pop(change)
        for i, (f, block) in enumerate(made):
            if i == 1 and change in {"short", "bad"}:
                block = block[:-1] if change == "short" else block[:-1] + b"#"
            row = (f.get("warc-segment-origin-id", f["warc-record-id"]), int(f["warc-segment-number"]), f["warc-type"] if f["warc-type"] == "response" else None, "u", f.get("warc-payload-digest"), int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None, block)
            rows += [row] * (3 if change == "copy" else 1) + ([(*row[:6], block + b"x")] if change == "differ" and i == 2 else [])
    segments = spark.createDataFrame(rows, "origin string, number int, record_type string, target string, payload_digest string, total long, block binary").orderBy(F.rand(3))
    found = sorted((page_of(r.record_id), r.status, r.payload and bytes(r.payload).decode()) for r in reassembled(segments).collect())
    assert [f[:2] for f in found] == [(1, "whole"), (2, "missing_segment"), (3, "missing_segment"), (4, "missing_segment"), (5, "length_mismatch"), (6, "whole"), (6, "whole"), (6, "whole"), (7, "conflicting_segments"), (8, found[-1][1])]
    assert found[0][2] == "a text of some length" and found[5][2] == "copies" and found[-1][1] in {"digest_mismatch", "broken_chunk", "whole"}
