"""WARC archives: captures are written as request, response and metadata records, and put
together again through WARC-Concurrent-To.

Archives are .warc.gz files, a gzip member per record. Tasks write them below a folder
that driver and executors share and return the list of files; only listed files count,
so a task that is run again does no harm. Readers stream a file record by record.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from uuid import uuid4

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opquality.llm.common import cut, map_arrow, new_folder, write_parquet

FILE_BYTES = 64 << 20
BATCH_BYTES = 8 << 20
SMALL_RECORD = 2048
CAPTURE_TYPES = ("response", "revisit", "resource")
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_FIELD = "page-id"

RECORD = pa.schema([
    ("record_id", pa.string()), ("type", pa.string()), ("date", pa.string()), ("target_uri", pa.string()),
    ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()), ("payload_digest", pa.string()),
    ("head", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()),
])
RECORD_DDL = "record_id string, type string, date string, target_uri string, concurrent_to array<string>, refers_to string, payload_digest string, head string, payload_bytes long, payload binary"


def base32_of_hex(digest: Column) -> Column:
    """Base32 of a hex text of 40 digits: 5 hex digits are 4 digits of base 32."""
    digits = [F.lpad(F.conv(F.substring(digest, n, 5), 16, 32), 4, "0") for n in range(1, 41, 5)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(kind: str, page: int | None, digest: str) -> str:
    h = hashlib.md5(f"{kind} {page} {digest}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def _record(kind: str, record_id: str, date: str, uri: str | None, block: bytes, content_type: str, more: list[tuple[str, str]]) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", date)]
    if uri is not None:
        head.append(("WARC-Target-URI", " ".join(uri.split())))
    head += [*more, ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return text.encode() + block + b"\r\n\r\n"


def _member(record: bytes, level: int) -> bytes:
    # Small records need no large window, which costs more to set up than to fill.
    packer = zlib.compressobj(level, zlib.DEFLATED, 31) if len(record) > SMALL_RECORD else zlib.compressobj(level, zlib.DEFLATED, 16 + 11, 4)
    return packer.compress(record) + packer.flush()


def _capture(page: int | None, uri: str | None, payload: bytes, digest: str, response: int | None, date: str, level: int) -> bytes:
    """Request, response or revisit, and metadata of one page."""
    own = _record_id("capture", page, digest)
    with_capture = [("WARC-Concurrent-To", own)]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    marks = [("WARC-Payload-Digest", f"sha1:{digest}")]
    if response is None:
        kind, block = "response", http + payload
    else:
        kind, block = "revisit", http
        marks += [("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", _record_id("capture", response, digest))]
    path = "/" + (uri or "").partition("://")[2].partition("/")[2]
    host = (uri or "").partition("://")[2].partition("/")[0]
    request = f"GET {' '.join(path.split()) or '/'} HTTP/1.1\r\nHost: {' '.join(host.split())}\r\n\r\n".encode()
    fields = b"" if page is None else f"{PAGE_FIELD}: {page}\r\n".encode()
    return b"".join(_member(r, level) for r in (
        _record("request", _record_id("request", page, digest), date, uri, request, "application/http; msgtype=request", with_capture),
        _record(kind, own, date, uri, block, "application/http; msgtype=response", marks),
        _record("metadata", _record_id("metadata", page, digest), date, uri, fields, "application/warc-fields", with_capture),
    ))


def first_captures(pages: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """Rows of pages with `digest` (base32 SHA-1 of the payload) and `response` (for
    repeated payloads, the largest id that has it, null on the rows of that id).

    Only ids and digests are grouped; payloads move only if the repeated ids are more
    than the planner broadcasts, and then by id, so copies of a payload do not meet.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    keyed = pages.withColumn("digest", base32_of_hex(F.sha1(payload)))
    slim = keyed.select(F.col(id_col).alias("id"), "digest")
    largest = slim.groupBy("digest").agg(F.max("id").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = slim.join(largest, "digest").where(~F.col("id").eqNullSafe(F.col("response"))).select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), "response").distinct()
    later = write_parquet(later, "warc-revisits")
    return keyed.join(later, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left").drop("_id", "_digest")


def write_warc(
    pages: DataFrame, folder: str | None = None, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html",
    date: str | None = None, level: int = 1,
) -> DataFrame:
    """Three records per row of pages; a payload that more rows have is a response once,
    at the largest id, and revisits elsewhere. A null payload is empty, a null uri or id
    is left out of the records, and rows equal in id and payload repeat their records.
    Returns the list of files: path, records."""
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        part, out, path, size, records = TaskContext.get().partitionId(), None, "", 0, 0

        def listed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "records": [records]}, schema=pa.schema([("path", pa.string()), ("records", pa.int64())]))

        for batch in batches:
            for page, uri, payload, digest, response in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name = f"capture-{part:06d}-{uuid4().hex}.warc.gz"
                    path, size, records = f"{folder}/{name}", 0, 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                size += out.write(_capture(page, uri, payload or b"", digest, response, date, level))
                records += 3
                if size >= FILE_BYTES:
                    yield listed()
                    out = None
        if out is not None:
            yield listed()

    rows = first_captures(pages.select(id_col, uri_col, payload_col), id_col, payload_col)
    ordered = rows.select(F.col(id_col).cast("long").alias("page"), F.col(uri_col).cast("string").alias("uri"), F.col(payload_col).cast("string").cast("binary").alias("payload"), "digest", F.col("response").cast("long").alias("response"))
    return cut(map_arrow(ordered, tasks, "path string, records long"))


def archives(spark, folder: str) -> DataFrame:
    """The list of archive files below a folder, by any store that Spark reads."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(folder).select("path")


def batch_of(records: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*records), RECORD.types)], schema=RECORD)


def parse_records(stream) -> Iterator[list]:
    """Records of an open, unpacked archive, as values in the order of RECORD."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        head: dict[str, list[str]] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head.setdefault(name.strip().lower(), []).append(value.strip())
        block = stream.read(int(head.get("content-length", ["0"])[0]))
        one = lambda name: head[name][0] if name in head else None
        text, payload = "", block
        if (one("content-type") or "").startswith("application/http"):
            text, _, payload = block.partition(b"\r\n\r\n")
            text = text.decode("latin-1")
        digest = one("warc-payload-digest")
        yield [
            one("warc-record-id"), one("warc-type"), one("warc-date"), one("warc-target-uri"), head.get("warc-concurrent-to", []), one("warc-refers-to"),
            digest.partition(":")[2] if digest else None, text, len(payload), payload,
        ]


def full_length(head: str, payload_bytes: int) -> int:
    """Bytes of the payload that a revisit stands for, by its HTTP head."""
    for line in head.split("\r\n"):
        name, _, value = line.partition(":")
        if name.strip().lower() == "content-length" and value.strip().isdigit():
            return int(value)
    return payload_bytes


def read_warc(files: DataFrame, payloads: bool = True) -> DataFrame:
    """One row per record of the listed archives. payload_digest is that of the payload
    itself where it is there, and the stated one for revisits; payload_bytes likewise.
    Without payloads, those of captures are left out (null) and only metadata keep them."""
    count = max(1, files.count())

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, place = fs.FileSystem.from_uri(path)
                held, size = [], 0
                with io.BufferedReader(store.open_input_stream(place, compression="gzip"), 1 << 20) as stream:
                    for record in parse_records(stream):
                        kind = record[1]
                        if kind == "revisit":
                            record[8] = full_length(record[7], record[8])
                        elif kind in CAPTURE_TYPES:
                            record[6] = base64.b32encode(hashlib.sha1(record[9]).digest()).decode()
                        if not payloads and kind != "metadata":
                            record[9] = None
                        held.append(record)
                        size += len(record[9] or b"") + 500
                        if size >= BATCH_BYTES:
                            yield batch_of(held)
                            held, size = [], 0
                if held:
                    yield batch_of(held)

    return map_arrow(files.select("path").repartition(count), tasks, RECORD_DDL)


def assemble(files: DataFrame, payloads: bool = True) -> DataFrame:
    """One row per capture of the listed archives:

    capture_id  id of its response, revisit or resource record
    capture     that record
    request     the request record concurrent to it, and n_request how many there are
    metadata    the metadata record concurrent to it, and n_metadata how many there are

    Records belong to a capture if either names the other in WARC-Concurrent-To, or if one
    between them does. Of several requests or metadata records the one of least id is
    nested. Records that lead to no capture give a row without one, under the id they
    name first or their own. Repeated capture records give a row each.
    """
    slim = write_parquet(read_warc(files, payloads=False), "warc-heads")
    is_capture = F.col("type").isin(*CAPTURE_TYPES)
    named = slim.select("record_id", F.explode("concurrent_to").alias("other")).where("other is not null")
    links = named.unionByName(named.select(F.col("other").alias("record_id"), F.col("record_id").alias("other")))
    ids = slim.where(is_capture & F.col("record_id").isNotNull()).select(F.col("record_id").alias("other"), F.col("record_id").alias("capture_id")).distinct()
    parts = slim.where(~is_capture)
    part_links = links.join(parts.select("record_id").distinct(), "record_id")
    direct = part_links.join(ids, "other").groupBy("record_id").agg(F.min("capture_id").alias("direct"))
    by_way = part_links.join(direct.select(F.col("record_id").alias("other"), F.col("direct").alias("capture_id")), "other").groupBy("record_id").agg(F.min("capture_id").alias("by_way"))
    placed = parts.join(direct, "record_id", "left").join(by_way, "record_id", "left").withColumn(
        "capture_id", F.coalesce("direct", "by_way", F.try_element_at("concurrent_to", F.lit(1)), "record_id")
    )
    record = F.struct(*RECORD.names)
    nested = placed.groupBy("capture_id").agg(*[
        x for kind in ("request", "metadata") for x in (
            F.min(F.when(F.col("type") == kind, record)).alias(kind), F.count(F.when(F.col("type") == kind, 1)).alias(f"n_{kind}"))
    ])
    captures = read_warc(files).where(is_capture) if payloads else slim.where(is_capture)
    whole = captures.select(F.col("record_id").alias("capture_id"), record.alias("capture"))
    met = whole.join(nested, "capture_id", "left")
    orphans = nested.join(ids.select("capture_id"), "capture_id", "left_anti").withColumn("capture", F.lit(None).cast(whole.schema["capture"].dataType))
    return met.unionByName(orphans).withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_request", "n_metadata")})


def page_id() -> Column:
    """The page that a capture's metadata record names."""
    return F.regexp_extract(F.col("metadata.payload").cast("string"), rf"(?m)^{PAGE_FIELD}: (-?\d+)", 1).try_cast("long")
