import base64
import gzip
import hashlib
import io

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from opquality.llm.common import new_folder
from opquality.llm.warc import archives, assemble, page_id, parse_records, read_warc, write_warc

SCHEMA = "page_id long, url string, html string, type string, response string"
PAGES = [
    (1, "http://a.example/x y", "<p>one</p>"), (2, "http://a.example/", "<p>two</p>"), (3, "http://b.example/q", "<p>one</p>"), (4, None, ""), (5, "http://c.example", None),
    (6, "ftp://d", "WARC/1.1\r\nContent-Length: 5\r\n\r\nno record\r\n\r\n"), (7, "http://e.example/é", "é" * 40_000), (8, "http://f", "<p>one</p>"), (None, "http://g", "only"),
]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


@pytest.fixture(scope="module")
def files(spark):
    pages = spark.createDataFrame([(*p, "own", "own") for p in PAGES], SCHEMA).repartition(3)
    return write_warc(pages, date="2024-01-01T00:00:00Z")


def test_captures_come_back_whole(files):
    out = assemble(files).select(page_id().alias("page"), "capture", "request", "metadata", "n_request", "n_metadata").collect()
    assert len(out) == len(PAGES) and {(r.n_request, r.n_metadata) for r in out} == {(1, 1)}
    latest = {}
    for page, _, html in PAGES:
        latest[digest(html)] = max(page or 0, latest.get(digest(html), 0))
    ids = {r.page: r.capture.record_id for r in out}
    for page, url, html in PAGES:
        row = next(r for r in out if r.page == page)
        first = latest[digest(html)]
        assert row.capture.payload_digest == digest(html) and row.capture.payload_bytes == len((html or "").encode())
        assert row.capture.target_uri == url and row.request.concurrent_to == [row.capture.record_id]
        if (page or 0) == first:
            assert row.capture.type == "response" and row.capture.refers_to is None and bytes(row.capture.payload).decode() == (html or "")
        else:
            assert row.capture.type == "revisit" and row.capture.refers_to == ids[first] and bytes(row.capture.payload) == b""


def test_archives_are_valid_members(files):
    raw = b"".join(open(r.path.removeprefix("file:"), "rb").read() for r in files.collect())
    records = list(parse_records(gzip.GzipFile(fileobj=io.BytesIO(raw))))
    assert len(records) == 3 * len(PAGES) and files.agg(F.sum("records")).head()[0] == len(records)


def test_other_ways_to_name_a_capture(spark):
    folder = new_folder(spark, "warc-test")
    record = lambda kind, i, extra, block: gzip.compress(
        f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{i}>\r\n{extra}Content-Type: text/plain\r\nContent-Length: {len(block)}\r\n\r\n{block}\r\n\r\n".encode()
    )
    raw = b"".join([
        record("warcinfo", "info", "", "about"),
        # The response names its request; the metadata name the request only.
        record("request", "q1", "", "get"), record("response", "r1", "WARC-Concurrent-To: <q1>\r\n", "body"), record("metadata", "m1", "WARC-Concurrent-To: <q1>\r\n", "x"),
        record("resource", "r2", "", "alone"),
        record("request", "q3", "WARC-Concurrent-To: <lost>\r\n", "get"), record("metadata", "m3", "WARC-Concurrent-To: <lost>\r\n", "x"),
        record("metadata", "m4", "WARC-Concurrent-To: <r2>\r\n", "b"), record("metadata", "m5", "WARC-Concurrent-To: <r2>\r\n", "a"),
    ])
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base)
    with store.open_output_stream(f"{base}/one.warc.gz", compression=None) as out:
        out.write(raw)
    got = {r.capture_id: r for r in assemble(archives(spark, folder)).collect() if r.capture_id != "<info>"}
    assert (got["<r1>"].request.record_id, got["<r1>"].metadata.record_id) == ("<q1>", "<m1>")
    assert bytes(got["<r2>"].capture.payload) == b"alone" and got["<r2>"].request is None
    assert (got["<r2>"].metadata.record_id, got["<r2>"].n_metadata) == ("<m4>", 2)
    assert got["<lost>"].capture is None and got["<lost>"].request.record_id == "<q3>"
    assert set(got) == {"<r1>", "<r2>", "<lost>"}


def test_repeated_rows_and_empty_tables(spark):
    twice = spark.createDataFrame([(1, "u", "same"), (1, "u", "same"), (2, "u", "same")], "page_id long, url string, html string")
    assert sorted(r.capture.type for r in assemble(write_warc(twice)).collect()) == ["response", "revisit", "revisit"]
    none = write_warc(twice.where("page_id > 5"))
    assert read_warc(none).collect() == [] and assemble(none).collect() == []
