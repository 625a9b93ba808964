"""Archives opened into rows, in Python, with a budget for each archive."""

from __future__ import annotations

import gzip
import io
import lzma
import posixpath
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame


#: What damaged archives raise; entries read before stay.
DAMAGED = (OSError, EOFError, RuntimeError, NotImplementedError, ValueError, struct.error, zlib.error, lzma.LZMAError, tarfile.TarError, zipfile.BadZipFile)
#: Rows and bytes of a batch of opened entries.
BATCH_ROWS, BATCH_BYTES = 256, 16 << 20
#: Contents up to these bytes are stored in an archive as they are: packing doesn't make them smaller.
STORED_BYTES = 64


@dataclass(frozen=True)
class Limits:
    depth: int = 2
    entries: int = 10_000
    total: int = 250 << 20
    entry: int = 25 << 20


def kind(name: str) -> str:
    low = name.lower()
    for suffix, k in ((".zip", "zip"), (".tar.gz", "targz"), (".tgz", "targz"), (".tar", "tar"), (".gz", "gz")):
        if low.endswith(suffix):
            return k
    return ""


def safe_path(name: str) -> str | None:
    """An entry's clean relative path, or None if it is empty, absolute or leaves the archive."""
    p = name.replace("\\", "/")
    if not p or p.startswith("/"):
        return None
    p = posixpath.normpath(p)
    return None if p in (".", "..") or p.startswith("../") else p


def members(source: BinaryIO, how: str, limits: Limits, first: int = 0, last: int | None = None) -> Iterator[tuple[str, bytes]]:
    """(path, content) of accepted entries; one beyond the bytes ends the archive, as does a damaged one.

    ``source`` is read as a stream, or by seeking for a zip, of which places ``first`` to ``last`` of its directory are taken; one entry is held at a time.
    """
    count = total = 0

    def fits(content: bytes) -> bool:
        nonlocal count, total
        if count >= limits.entries or total + len(content) > limits.total:
            return False
        count, total = count + 1, total + len(content)
        return True

    try:
        if how == "zip":
            with zipfile.ZipFile(source) as z:
                for info in z.infolist()[first:last]:
                    path = safe_path(info.filename)
                    if info.is_dir() or path is None or info.file_size > limits.entry:
                        continue
                    try:
                        with z.open(info) as f:
                            content = f.read(limits.entry + 1)
                    except DAMAGED:
                        continue
                    if len(content) > limits.entry:
                        continue
                    if not fits(content):
                        return
                    yield path, content
        else:
            with tarfile.open(fileobj=source, mode="r|gz" if how == "targz" else "r|") as t:
                for info in t:
                    t.members = []  # a stream of any length keeps no list of what it passed
                    path = safe_path(info.name)
                    if not info.isreg() or path is None or info.size > limits.entry:
                        continue
                    f = t.extractfile(info)
                    content = f.read(limits.entry + 1) if f else b""
                    if not fits(content):
                        return
                    yield path, content
    except DAMAGED:
        return


def expand_from(file: str, source: BinaryIO, limits: Limits = Limits(), depth: int = 0, first: int = 0, last: int | None = None) -> Iterator[tuple[str, bytes]]:
    """(virtual path, content) of what an archive that is read from ``source`` holds."""
    how = kind(file)
    if how == "gz":
        try:
            with gzip.open(source) as f:
                inner = f.read(limits.entry + 1)
        except DAMAGED:
            return
        base = posixpath.basename(file.rsplit("!/", 1)[-1])
        name = base[:-3] if base.endswith(".gz") and len(base) > 3 else "decompressed"
        if len(inner) <= limits.entry:
            yield from expand(f"{file}!/{name}", inner, limits, depth + 1)
    else:
        for path, inner in members(source, how, limits, first, last):
            yield from expand(f"{file}!/{path}", inner, limits, depth + 1)


def expand(file: str, content: bytes, limits: Limits = Limits(), depth: int = 0) -> Iterator[tuple[str, bytes]]:
    """(virtual path, content) of what a file holds; a file that isn't opened is itself."""
    if depth <= limits.depth and kind(file):
        yield from expand_from(file, io.BytesIO(content), limits, depth)
    else:
        yield file, content


def in_batches(rows: Iterable[tuple[str, str | None, bytes]]) -> Iterator[pa.RecordBatch]:
    """Rows (file, commit, content) in batches of bounded rows and bytes."""
    held: list[tuple[str, str | None, bytes]] = []
    size = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in held], pa.string()), pa.array([r[1] for r in held], pa.string()), pa.array([r[2] for r in held], pa.binary())], ["file", "commit", "content"])

    for file, commit, content in rows:
        held.append((file.encode("utf-8", "replace").decode(), commit, content))
        size += len(content)
        if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """The batches' rows one by one: a batch of large contents is never a second time in memory, nor there with the next one."""
    for batch in batches:
        columns = batch.columns
        for k in range(batch.num_rows):
            yield tuple(c[k].as_py() for c in columns)
        batch = columns = None


def opened(sources: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``sources`` (file, commit, content) with archives replaced by their entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_batches((path, commit, inner) for file, commit, content in rows_of(batches) for path, inner in expand(file, content or b"", limits))

    return sources.select("file", "commit", "content").mapInArrow(run, "file string, commit string, content binary")


def gzipped(sources: DataFrame) -> DataFrame:
    """``sources`` with each content as a gzip archive of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [f"{x}.gz" for x in batch.column(0).to_pylist()]
            packed = [gzip.compress(x or b"", mtime=0) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), batch.column(1), pa.array(packed, pa.binary())], ["file", "commit", "content"])

    rows = sources.select("file", "commit", sources["content"].cast("binary").alias("content"))
    return rows.mapInArrow(run, "file string, commit string, content binary")


def _packed(name: str, content: bytes) -> zipfile.ZipInfo:
    """An entry without a time, so that an archive that is made again has the same bytes."""
    entry = zipfile.ZipInfo(name)
    entry.external_attr = 0o600 << 16
    entry.compress_type = zipfile.ZIP_DEFLATED if len(content) > STORED_BYTES else zipfile.ZIP_STORED
    return entry


def sorted_entries(entries: DataFrame) -> DataFrame:
    """The entries (archive, name, content), each archive's in one task, by name."""
    rows = entries.select("archive", "name", entries["content"].cast("binary").alias("content"))
    return rows.repartition("archive").sortWithinPartitions("archive", "name", "content")


def by_archive(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, Iterator[tuple[str, bytes]]]]:
    """Each archive of sorted entries with its (name, content), one after another."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for archive, own in groupby(rows, key=itemgetter(0)):
        yield archive, (row[1:] for row in own)


def pack(out: BinaryIO, entries: Iterable[tuple[str, bytes]]) -> None:
    """A zip of the entries, written to a file or stream as they come."""
    with zipfile.ZipFile(out, "w") as z:
        for name, content in entries:
            z.writestr(_packed(name, content), content)


def zipped(entries: DataFrame) -> DataFrame:
    """A zip archive for each ``archive`` of the entries (archive, name, content), by name; a task packs one at a time from its sorted rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for archive, own in by_archive(batches):
            out = io.BytesIO()
            pack(out, own)
            yield pa.RecordBatch.from_arrays([pa.array([archive], pa.string()), pa.array([""]), pa.array([out.getvalue()], pa.binary())], ["file", "commit", "content"])

    return sorted_entries(entries).mapInArrow(run, "file string, commit string, content binary")
