"""WARC archives: a writer with revisit records, and a splittable reader of gzip members.

The writer makes each page one gzip member: of pages with equal payloads the one with the smallest page_id is a
response, the others are revisits that refer to it. Every task writes archives of its own under a fresh name and
reports them, so that a repeated attempt leaves an unlisted file and never a double record.

The reader cuts archives into byte ranges without an index. A task looks for the gzip magic from its range's start on,
takes a place for a member if its first bytes decompress to a WARC header, and from there follows members from end to
start; it owns the records that start inside its range, whole, even where they end beyond it. UTF-8 payloads cannot
hold the magic unpacked, and a chance hit in packed bytes does not decompress to a WARC header.

Nulls: null html is an empty payload, a null url leaves out the target header, a null page_id comes back as null and is
a response's only if no page of its payload has an id. Repeated rows that share the smallest page_id of their payload
are all responses. Empty pages give no archives and no rows. Extra columns are ignored. A damaged member is a row that
holds only its archive, its place and what is wrong with it (``error``); reading goes on at the next member. The round
trip raises on such a row, as its own archives have none.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.llm.common import row_blocks, stored
from claimscope.llm.files import opened
from claimscope.session import shared_path

LEAST_BYTES = 0
#: A task's byte range, and the most tasks that read at a time: beyond them, tasks take several ranges.
RANGE_BYTES, MOST_TASKS = 128 << 20, 100_000
DATE = "2024-01-01T00:00:00Z"
MAGIC = b"\x1f\x8b\x08"
#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PAGE = "<urn:page:"

RECORDS = "page_id long, record_type string, target_uri string, payload_digest string, payload_bytes long, refers_to long, payload binary, path string, offset long, error string"


class Record(NamedTuple):
    page_id: int | None
    record_type: str | None
    target_uri: str | None
    payload_digest: str | None
    payload_bytes: int | None
    refers_to: int | None
    payload: bytes | None
    path: str | None = None
    offset: int | None = None
    error: str | None = None


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str) -> str:
    return "".join(c if c >= " " else f"%{ord(c):02X}" for c in value)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """One record, unpacked."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_PAGE}{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_line(url)}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_PAGE}{'' if refers_to is None else refers_to}>"]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> Record:
    """A record from its unpacked bytes; the payload's digest is checked against its header."""
    head, _, block = data.partition(b"\r\n\r\n")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in head.decode("utf-8").split("\r\n")[1:])}
    block = block[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
    of = {k: int(v) if (v := fields[k].removeprefix(_PAGE).rstrip(">")) else None for k in ("warc-record-id", "warc-refers-to") if k in fields}
    kind, said = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and (digest(payload) != said or len(payload) != length):
        raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
    return Record(of["warc-record-id"], kind, fields.get("warc-target-uri"), said, length, of.get("warc-refers-to"), payload if kind == "response" else None)


def write_archives(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write pages to archives below ``folder``; returns the stored list of (path, size, records)."""
    chosen = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8").alias("payload")
    ).withColumn("digest", F.sha1("payload"))
    # only payloads that occur again are joined; the runtime size of that table decides how
    again = (
        chosen.where(F.octet_length("payload") >= least_bytes)
        .groupBy(F.col("digest").alias("same"))
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .drop("n")
    )
    linked = chosen.join(again, F.col("digest") == F.col("same"), "left").select("page_id", "url", "payload", "first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = opened(folder)
        name, out, records = f"pages-{uuid.uuid4().hex}.warc.gz", None, 0
        for block in row_blocks(batches):
            if out is None:
                files.create_dir(root, recursive=True)
                out = files.open_output_stream(f"{root}/{name}", compression=None)
            for page_id, url, payload, first in zip(*(c.to_pylist() for c in block.columns), strict=True):
                revisit = first is not None and page_id != first
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                out.write(packer.compress(record_bytes(page_id, url, payload, first, revisit)) + packer.flush())
                records += 1
        if out is not None:
            size = out.tell()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([size], pa.int64()), pa.array([records], pa.int64())], ["path", "size", "records"])

    return stored(linked.mapInArrow(write, "path string, size long, records long"), "archives")


#: The round trip in SQL: base 32 in groups of 20 bits, as hexadecimal digits give them.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, payload, sha1(payload) AS h, min(page_id) OVER (PARTITION BY payload) AS first FROM p),
g AS (SELECT *, list_transform(range(0, 8), lambda k: CAST('0x' || substr(h, 5 * k + 1, 5) AS INTEGER)) AS v FROM d)
SELECT page_id, octet_length(encode(payload)) AS payload_bytes,
  array_to_string(list_transform(v, lambda x: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((x >> s) & 31) + 1 AS INTEGER), 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM g
"""


def _unpacked(source, at: int, whole: bool = True) -> tuple[bytes, int] | None:
    unpacker, out, pos, size = zlib.decompressobj(31), [], at, source.size()
    known = False
    while pos < size and not unpacker.eof:
        data = source.read_at(min(1 << 16 if known else 1 << 12, size - pos), pos)
        pos += len(data)
        try:
            out.append(unpacker.decompress(data))
        except zlib.error:
            if known:
                raise
            return None
        if not known and sum(map(len, out)) >= len(VERSION):
            if not b"".join(out).startswith(b"WARC/1."):
                return None
            known = True
            if not whole:
                return b"".join(out), pos
    if not known:
        return None
    if not unpacker.eof:
        raise ValueError("an archive ends within a record")
    return b"".join(out), pos - len(unpacker.unused_data)


def _next_member(source, start: int, end: int) -> int | None:
    """The first place from ``start`` on, before ``end``, at which a WARC member starts."""
    pos, step, size = start, 1 << 18, source.size()
    while pos < min(end, size):
        data = source.read_at(min(step + len(MAGIC) - 1, size - pos), pos)
        at = data.find(MAGIC)
        while 0 <= at < step:
            if pos + at >= end:
                return None
            if _unpacked(source, pos + at, whole=False):
                return pos + at
            at = data.find(MAGIC, at + 1)
        pos += step
    return None


def records_in(uri: str, start: int, end: int) -> Iterator[Record]:
    """The records of an archive that start in a byte range; a damaged member gives a record that holds only its error."""
    files, path = opened(uri)
    with files.open_input_file(path) as source:
        size, at = source.size(), _next_member(source, start, end)
        while at is not None and at < end:
            try:
                found = _unpacked(source, at)
                if found is not None:
                    yield parsed(found[0])._replace(path=uri, offset=at)
            except (ValueError, KeyError, StopIteration, zlib.error) as error:
                yield Record(None, None, None, None, None, None, None, uri, at, f"{type(error).__name__}: {error}")
                found = None
            if found is None:
                at = _next_member(source, at + 1, end)
                continue
            at = found[1]
            if at < min(end, size) and source.read_at(len(MAGIC), at) != MAGIC:
                at = _next_member(source, at, end)
            elif at >= size:
                break


def read_archives(archives: DataFrame, range_bytes: int = RANGE_BYTES, payloads: bool = True) -> DataFrame:
    """The records of archives (path, size), read in byte ranges by as many tasks as there are ranges."""
    ranges = archives.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    tasks = max(1, min(MOST_TASKS, ranges.count()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.string()]
        schema = pa.schema(list(zip(Record._fields, kinds, strict=True)))

        def batch(rows: list[Record]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for block in batches:
            for path, start in zip(block.column(0).to_pylist(), block.column(1).to_pylist(), strict=True):
                rows, held = [], 0
                for r in records_in(path, start, start + range_bytes):
                    rows.append(r if payloads else r._replace(payload=None))
                    held += len(rows[-1].payload or b"") + 200
                    if held > 4 << 20:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    return ranges.repartition(tasks).mapInArrow(read, RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages and read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    archives = write_archives(pages, shared_path(pages.sparkSession, "warc"))
    found = read_archives(archives, payloads=False)
    whole = F.when(F.col("error").isNull(), F.col("record_type")).otherwise(F.raise_error(F.concat_ws(" ", "path", "offset", "error")))
    return found.select("page_id", "payload_bytes", "payload_digest", whole.alias("record_type"), "refers_to")
