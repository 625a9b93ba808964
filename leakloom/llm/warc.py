"""WARC archives as a chunked record table.

A record is one or more rows (record_no, chunk_no, data, payload_digest, last): chunk 0 is the
record's header with the HTTP header of its block, the others hold up to ``CHUNK`` bytes of the
payload. Each row carries the digest of the payload up to its own end, made incrementally, so a
reader checks every chunk as it streams and never holds a whole record. The rows of a record
joined, in order, and CR LF CR LF are its WARC/1.1 bytes (``write_file``, ``iter_records``).

Of records with equal payloads that with the smallest page id is the response; the others are
revisit records that name it and carry no payload. Only a key and a minimum cross the grouping, so
a payload that many pages share costs one row per task there.

Defined cases: null html is an empty payload; a null id is larger than any other; rows that repeat
id and payload are all responses (no other record has a smaller id); an empty table writes an empty
archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches

CHUNK = 64 << 10
#: A batch holds at most this many chunks: some 4 MB.
CHUNKS_AT_ONCE = 64
CRLF = b"\r\n"
DATE = "2024-01-01T00:00:00Z"
SCHEMA = "record_no long, chunk_no long, data binary, payload_digest string, last boolean"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The base32 alphabet of RFC 4648, for the digits of a number in base 32.
DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 SHA-1, from SQL functions: five hex digits are four of base 32."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), DIGITS, BASE32)


def record_uri(page_id: object) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def header(kind: str, page_id: object, url: str | None, digest: str, size: int, first: object) -> bytes:
    """A record's WARC header and the HTTP header that opens its block."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_uri(page_id)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        lines.append("WARC-Target-URI: " + " ".join(url.split()))
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_uri(first)}"]
    lines.append(f"Content-Length: {len(http) + (size if kind == 'response' else 0)}")
    return "\r\n".join(lines).encode() + CRLF + CRLF + http


def chunks(head: bytes, payload: bytes, chunk: int = CHUNK) -> Iterator[tuple[int, bytes, str, bool]]:
    """A record's rows: number, bytes, digest of the payload so far, whether it is the last."""
    digest, parts = hashlib.sha1(), range(0, len(payload), chunk)
    text = lambda: base64.b32encode(digest.copy().digest()).decode()
    yield 0, head, text(), not len(parts)
    view = memoryview(payload)
    for k, at in enumerate(parts, 1):
        part = view[at : at + chunk]
        digest.update(part)
        yield k, bytes(part), text(), k == len(parts)


def plan(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """(page_id, url, payload, size, digest, first): ``first`` is the response's id for revisits, else null."""
    rows = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("size"), base32_sha1(F.col("payload")).alias("digest"))
    smallest = rows.where(F.col("size") >= min_payload).groupBy(F.col("digest").alias("d"), F.col("size").alias("n")).agg(F.min("page_id").alias("smallest"))
    joined = rows.join(smallest, (F.col("digest") == F.col("d")) & (F.col("size") == F.col("n")), "left")
    return joined.select("page_id", "url", "payload", "size", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("smallest")), F.col("smallest")).alias("first"))


def chunk_rows(planned: DataFrame) -> DataFrame:
    """The chunked record table of ``plan``'s rows."""
    bound_batches(planned.sparkSession, CHUNKS_AT_ONCE)
    rows = planned.select(F.monotonically_increasing_id().alias("record_no"), "page_id", "url", "digest", "size", "first", F.when(F.col("first").isNull(), F.col("payload")).alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_no", pa.int64()), ("chunk_no", pa.int64()), ("data", pa.binary()), ("payload_digest", pa.string()), ("last", pa.bool_())])
        out: list[tuple] = []
        for batch in batches:
            for no, page, url, digest, size, first, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                head = header("response" if first is None else "revisit", page, url, digest, size, first)
                for row in chunks(head, payload or b""):
                    out.append((no, *row))
                    if len(out) >= CHUNKS_AT_ONCE:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                        out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return rows.mapInArrow(run, SCHEMA)


def write(pages: DataFrame, path: str, min_payload: int = 0) -> None:
    """Write a WARC record per page to the chunk table at ``path``.

    The shuffle that finds equal payloads is of no use once the table is written, so its files go with the write
    and don't lie beside those of the reading.
    """
    conf, key = pages.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        chunk_rows(plan(pages, min_payload)).write.option("compression", "zstd").parquet(path)
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


def parse_header(head: bytes) -> dict[str, str]:
    """Fields of the WARC header (as named, lower-case) and of the HTTP header (prefix ``http-``)."""
    warc, _, http = head.partition(CRLF + CRLF)
    out = {}
    for prefix, part in (("", warc), ("http-", http)):
        for line in part.split(CRLF)[1:]:
            name, sep, value = line.partition(b":")
            if sep:
                out[prefix + name.decode().lower()] = value.strip().decode()
    return out


class _Reader:
    """Checks the chunks of one record after the other as they come."""

    def __init__(self) -> None:
        self.no = None

    def feed(self, no: int, chunk_no: int, data: bytes, digest: str, last: bool) -> tuple | None:
        if chunk_no == 0:
            self.no, self.next, self.size, self.fields, self.digest = no, 1, 0, parse_header(data), hashlib.sha1()
        elif no != self.no or chunk_no != self.next:
            raise ValueError(f"record {no}: chunk {chunk_no} is out of order")
        else:
            self.next += 1
            self.size += len(data)
            self.digest.update(data)
        so_far = base64.b32encode(self.digest.copy().digest()).decode()
        if so_far != digest:
            raise ValueError(f"record {no}: chunk {chunk_no} doesn't have its digest")
        if not last:
            return None
        f = self.fields
        kind, size, named = f["warc-type"], int(f["http-content-length"]), f["warc-payload-digest"].removeprefix("sha1:")
        if kind == "response" and (named != so_far or size != self.size):
            raise ValueError(f"record {no}: the payload isn't the one that its header names")
        of = lambda uri: int(x) if (x := uri.removeprefix("<urn:x-page:").rstrip(">")) else None
        return of(f["warc-record-id"]), size, named, kind, of(f["warc-refers-to"]) if kind == "revisit" else None


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of the chunk table: page_id, payload_bytes, payload_digest, record_type, refers_to.

    The chunks of a record meet in one partition, sorted, and stream through a digest.
    """
    bound_batches(spark, CHUNKS_AT_ONCE)
    rows = spark.read.schema(SCHEMA).parquet(path).repartition("record_no").sortWithinPartitions("record_no", "chunk_no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader()
        for batch in batches:
            found = [x for row in zip(*(c.to_pylist() for c in batch.columns), strict=True) if (x := reader.feed(*row))]
            if found:
                page, size, digest, kind, first = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(page, pa.int64()), pa.array(size, pa.int64()), pa.array(digest, pa.string()), pa.array(kind, pa.string()), pa.array(first, pa.int64())], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return rows.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def write_file(records: Iterable[tuple[bytes, Iterable[bytes]]], out: BinaryIO) -> None:
    """Write records, each a header and the chunks of its payload, as the bytes of a WARC file."""
    for head, parts in records:
        out.write(head)
        for part in parts:
            out.write(part)
        out.write(CRLF + CRLF)


def iter_records(source: BinaryIO, chunk: int = CHUNK) -> Iterator[tuple[dict[str, str], Iterator[bytes]]]:
    """Records of a WARC file: the header's fields, and the block in chunks, as a stream.

    The next record can be asked for at any time; what is left of a block is skipped.
    """
    while True:
        line = source.readline()
        while line in (CRLF, b"\n"):
            line = source.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        lines = [line]
        while (line := source.readline()) not in (CRLF, b"\n", b""):
            lines.append(line)
        fields = parse_header(b"".join(lines))
        left = [int(fields["content-length"])]

        def block(left: list[int] = left) -> Iterator[bytes]:
            while left[0]:
                part = source.read(min(chunk, left[0]))
                if not part:
                    raise ValueError("the file ends inside a record")
                left[0] -= len(part)
                yield part

        yield fields, block()
        for _ in block():
            pass
