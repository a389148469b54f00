"""WARC archives in which pages with the same payload are revisits of one response.

Headers (id, address, digest; no payloads) are shuffled by payload digest; the
smallest page_id of a digest is its original.  Revisits are joined to originals,
and the pages, dealt by id, are written one gzip member a record with fresh
headers.  A task writes its archive under a name of its own attempt and renames
it when it is whole, so a repeated task leaves one archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import fresh, small_batches, written

_SPACE = uuid.UUID("5b1f2a9e-6a0c-4d52-9c0e-7a7f0c1f5e11")


def _record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page}:{digest}')}>"


def _headers(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *[f"{k}: {v}" for k, v in fields if v is not None], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _address(url: str | None, page: int | None) -> str:
    return quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else f"urn:page:{page}"


def response_record(page: int | None, url: str | None, payload: bytes, date: str) -> bytes:
    """A response with its HTTP head and payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", _record_id(page, digest)), ("WARC-Date", date), ("WARC-Target-URI", _address(url, page)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-Id", page), ("Content-Type", "application/http;msgtype=response")]
    return _headers(fields, block)


def revisit_record(page: int, url: str | None, digest: str, size: int, original: int, original_url: str | None, date: str) -> bytes:
    """A revisit: no payload, but a reference to the original response."""
    fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", _record_id(page, digest)), ("WARC-Date", date), ("WARC-Target-URI", _address(url, page)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _record_id(original, digest)), ("WARC-Refers-To-Target-URI", _address(original_url, original)), ("WARC-Refers-To-Date", date), ("X-Page-Id", page), ("X-Refers-To-Page-Id", original), ("X-Payload-Length", size), ("Content-Type", "application/http;msgtype=response")]
    return _headers(fields, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n\r\n")


def _member(record: bytes, level: int) -> bytes:
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeeze.compress(record) + squeeze.flush()


def members(stream: BinaryIO, size: int = 1 << 20) -> Iterator[bytes]:
    """The records of a gzipped archive, one at a time; a cut-off archive is an EOFError."""
    left = b""
    while left or (left := stream.read(size)):
        unzip, parts = zlib.decompressobj(31), []
        while not unzip.eof:
            if not left and not (left := stream.read(size)):
                raise EOFError("the archive ends within a record")
            parts.append(unzip.decompress(left))
            left = unzip.unused_data
        yield b"".join(parts)


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields by lower-case name, and the block."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    n = int(fields["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    return fields, rest[:n]


def revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, digest, original, original_url) of pages whose payload of `least` bytes or more a smaller page_id has."""
    heads = pages.where(F.col("size") >= least).select("page_id", "url", "digest")
    first = heads.groupBy("digest").agg(F.min("page_id").alias("original"), F.min_by("url", "page_id").alias("original_url"), F.count("*").alias("held"))
    first = written(first.where("held > 1").drop("held"), "originals")  # a table of its own: both sides of the join are exchanged, so a hot digest can be split
    found = heads.select("page_id", "digest").join(first, "digest").where("page_id > original")
    return found.select("page_id", "digest", "original", "original_url").distinct()


def write_archives(pages: DataFrame, path: str, *, least: int = 0, date: str = "2000-01-01T00:00:00Z", level: int = 6, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write a record per row of `pages` under `path` and return (file, records), one row an archive.

    A null payload is empty, a null address is named after the page.  Pages
    with a null id are responses always.  Of repeated rows with the smallest id
    each is a response.  Other columns are not read.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = small_batches(pages).select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload"))).withColumn("size", F.length("payload").cast("long"))
    again = revisits(rows, least)
    rows = rows.join(again, ["page_id", "digest"], "left").select("page_id", "url", "digest", "size", F.when(F.col("original").isNull(), F.col("payload")).alias("payload"), "original", "original_url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, top = fs.FileSystem.from_uri(path)
        store.create_dir(top, recursive=True)
        name = f"{top}/archive-{context.partitionId():06d}"
        trial, count = f"{name}.{context.taskAttemptId()}.part", 0
        with store.open_output_stream(trial, compression=None) as out:
            out.write(_member(_headers([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_SPACE, name)}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"), level))
            for batch in batches:
                for lo in range(0, batch.num_rows, 200):
                    for r in batch.slice(lo, 200).to_pylist():
                        if r["original"] is None:
                            record = response_record(r["page_id"], r["url"], r["payload"], date)
                        else:
                            digest = base64.b32encode(r["digest"]).decode()
                            record = revisit_record(r["page_id"], r["url"], digest, r["size"], r["original"], r["original_url"], date)
                        out.write(_member(record, level))
                        count += 1
        if store.get_file_info(f"{name}.warc.gz").type == fs.FileType.NotFound:
            store.move(trial, f"{name}.warc.gz")
        else:  # an earlier attempt wrote the same records
            store.delete_file(trial)
        yield pa.RecordBatch.from_arrays([pa.array([f"{name}.warc.gz"]), pa.array([count], pa.int64())], names=["file", "records"])

    return written(rows.mapInArrow(write, "file string, records bigint"), "archives")


def read_archives(spark: SparkSession, files: DataFrame, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, record_id of the records in `files`; responses' digests are tested."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(path)
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("record_id", pa.string())])
        for batch in batches:
            for file in batch.column(0).to_pylist():
                out = []
                with store.open_input_stream(file, compression=None) as stream:
                    for record in members(stream):
                        fields, block = parse_record(record)
                        kind = fields["warc-type"]
                        if kind == "warcinfo":
                            continue
                        digest = fields["warc-payload-digest"].removeprefix("sha1:")
                        size = fields.get("x-payload-length")
                        if kind == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                                raise ValueError(f"{file}: a payload differs from its digest")
                            size = len(payload)
                        number = lambda k: int(fields[k]) if k in fields else None  # noqa: B023, E731
                        out.append((number("x-page-id"), int(size), digest, kind, number("x-refers-to-page-id"), fields["warc-target-uri"], fields["warc-record-id"]))
                        if len(out) == 5000:
                            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)
                            out = []
                if out:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)

    found = files.select("file").repartition(max(1, files.count()))
    return found.mapInArrow(read, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, record_id string")


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write `pages` as archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = fresh(spark, "warc")
    return read_archives(spark, write_archives(pages, path, **options), path)
