"""Archives in files of any size, read where they lie: a zip by ranges of its directory, others as streams.

No archive is ever a row or whole in memory. One task reads the directory of a zip and gives its ranges, each of about
``size`` bytes of entries; the ranges are dealt to tasks, which seek to their entries and hold one at a time. A tar, a gz
and a zip whose directory declares more than the budget of ``Limits`` are one range: there the budget follows the order of the
entries, and stops the reading. So results equal those of ``archives.opened``. Damaged archives and entries end quietly;
a store that fails to give bytes does not: the task fails and is tried again. A zip's directory is held in memory
by each task that reads a range of it. Where files lie, every executor must reach.
"""

from __future__ import annotations

import math
import os
import zipfile
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archives, files, stores, tables
from .archives import Limits

#: Bytes of entries in a range, and in a task.
RANGE_BYTES, TASK_BYTES = 64 << 20, 128 << 20
#: Ranges of a batch.
BATCH_RANGES = 4096
#: Bytes of an archive that is packed which are written at a time.
WRITE_BYTES = 1 << 20


class ReadFailed(Exception):
    """The store did not give the bytes: not the archive's fault."""


class _Reads:
    """A file that is read and sought; what its store raises is never taken for a damaged archive."""

    def __init__(self, file: BinaryIO) -> None:
        self.file = file

    def __enter__(self) -> _Reads:
        return self

    def __exit__(self, *exc) -> None:
        self.file.close()

    def read(self, size: int = -1) -> bytes:
        try:
            return self.file.read() if size is None or size < 0 else self.file.read(size)
        except OSError as e:
            raise ReadFailed(str(e)) from e

    def seek(self, offset: int, whence: int = 0) -> int:
        if (whence == 0 and offset < 0) or (whence == 2 and offset + self.size() < 0):
            raise OSError("before the beginning")  # as files do, which readers of archives expect
        try:
            return self.file.seek(offset, whence)
        except OSError as e:
            raise ReadFailed(str(e)) from e

    def size(self) -> int:
        at = self.file.tell()
        end = self.file.seek(0, 2)
        self.file.seek(at)
        return end

    def tell(self) -> int:
        return self.file.tell()

    def seekable(self) -> bool:
        return True

    def close(self) -> None:
        """Readers of the archive leave the file open for the next one."""

    @property
    def closed(self) -> bool:
        return self.file.closed


def open_file(path: str) -> _Reads:
    store, name = stores.of(path)
    return _Reads(store.open_input_file(name))


def _ranges(file: str, source: BinaryIO, limits: Limits, size: int) -> Iterator[tuple[int, int | None, int]]:
    """(first, last, bytes) of the ranges of an archive; last is None for the whole."""
    if archives.kind(file) != "zip":
        yield 0, None, source.size()
        return
    try:
        with zipfile.ZipFile(source) as z:
            sizes = [i.file_size if not i.is_dir() and archives.safe_path(i.filename) is not None and i.file_size <= limits.entry else -1 for i in z.infolist()]
    except archives.DAMAGED:
        return
    taken = [x for x in sizes if x >= 0]
    if len(taken) > limits.entries or sum(taken) > limits.total:
        yield 0, None, min(sum(taken), limits.total)
        return
    first = held = 0
    for k, x in enumerate(sizes):
        held += max(x, 0)
        if held >= size or k + 1 == len(sizes):
            yield first, k + 1, held
            first, held = k + 1, 0


def ranges(listed: DataFrame, limits: Limits = Limits(), size: int = RANGE_BYTES) -> DataFrame:
    """(path, file, first, last, bytes): the ranges of archives (path, file). Files that are gone have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for path, file in _rows(batches):
            try:
                source = open_file(path)
            except FileNotFoundError:
                continue
            with source:
                for r in _ranges(file, source, limits, size):
                    out.append((path, file, *r))
                    if len(out) == BATCH_RANGES:
                        yield _batch(out)
                        out = []
        if out:
            yield _batch(out)

    return listed.select("path", "file").mapInArrow(run, "path string, file string, first long, last long, bytes long")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    return (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), SCHEMA)], schema=SCHEMA)


SCHEMA = pa.schema([("path", pa.string()), ("file", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("bytes", pa.int64())])


def joined(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Ranges (path, file, first, last) with those that follow one another in an archive as one, so that its directory is read once."""
    held = None
    for path, file, first, last in rows:
        if held and held[:2] == (path, file) and last is not None and held[3] == first:
            held = (*held[:3], last)
            continue
        if held:
            yield held
        held = path, file, first, last
    if held:
        yield held


def entries(of: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(file, commit, content) of what the ranges hold, nested archives opened."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, bytes]]:
        for path, file, first, last in joined(_rows(batches)):
            try:
                source = open_file(path)
            except FileNotFoundError:
                continue
            with source:
                for inner, content in archives.expand_from(file, source, limits, 0, first, last):
                    yield inner, "", content

    return of.select("path", "file", "first", "last").mapInArrow(lambda batches: archives.in_batches(rows(batches)), "file string, commit string, content binary")


def opened(listed: DataFrame, limits: Limits = Limits(), size: int = RANGE_BYTES) -> DataFrame:
    """Entries of archives (path, file). The ranges are written once, and dealt to as many tasks as their bytes need, neighbours to the same one."""
    planned = tables.written(ranges(listed, limits, size), "ranges")
    total = planned.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    tasks = max(1, math.ceil(total / TASK_BYTES), min(planned.sparkSession.sparkContext.defaultParallelism, planned.count()))
    return entries(planned.repartitionByRange(tasks, "path", "first").sortWithinPartitions("path", "first"), limits)


def read_folder(spark: SparkSession, root: str, limits: Limits, include: list[str] = (), exclude: list[str] = (), max_file: int = files.MAX_FILE) -> DataFrame:
    """(file, commit, content) of the files below a folder, or of a single file, whose archives are opened where they lie."""
    if os.path.isfile(root):
        if not archives.kind(root):
            return files.read_file(spark, root)
        return opened(spark.createDataFrame([(root, os.path.basename(root))], "path string, file string"), limits)
    kept = files.listed(spark, root, include, exclude, max_file, True)
    packed = files.archive_kind(F.col("file")) != ""
    return kept.where(~packed).select("file", "commit", "content").unionByName(opened(kept.where(packed), limits))


def zip_files(entries: DataFrame, folder: str) -> DataFrame:
    """(path, file) of the zips that ``archives.zipped`` makes of the entries (archive, name, content), packed into files below a folder that all executors share.

    An archive is written as its rows come: a task holds its directory, never its bytes. Names must be unique plain file names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = stores.of(folder)
        store.create_dir(base, recursive=True)
        for name, own in archives.by_archive(batches):
            draft = f"{base}/.{name}-{os.urandom(8).hex()}"
            with store.open_output_stream(draft, buffer_size=WRITE_BYTES) as out:
                archives.pack(out, own)
            store.move(draft, f"{base}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([name])], ["path", "file"])

    return archives.sorted_entries(entries).mapInArrow(run, "path string, file string")
