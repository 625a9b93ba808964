"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every word rule here: blank and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows and bytes of one Arrow batch. A Python worker holds a few batches, whatever the size of
#: the partition, so this is what bounds its memory; a single row is never split.
BATCH_ROWS = 512
BATCH_BYTES = 16 << 20
#: Bytes of text that vector code works on at a time.
SLICE_BYTES = 1 << 19


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Limit the Arrow batches of the session's next Python stages."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches one by one; what Arrow holds of an earlier one goes back to the system, as the worker outlives its task."""
    for batch in batches:
        yield batch
        batch = None
        pa.default_memory_pool().release_unused()
    pa.default_memory_pool().release_unused()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the cluster's shared folder.

    ``spark.checkpoint.dir`` names that folder. Only where it is unset and Spark runs on this machine
    alone, as in tests, a temporary folder is used; on a cluster its lack is an error.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, also set as the checkpoint folder."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="leakloom-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of an id as text, modulo; a null id counts as the empty text (remainder 0)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, also where a lambda uses it often."""
    return F.transform(F.array(value), body)[0]


_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_R_INVERSE = np.uint64(pow(int(_R), -1, 2**64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_R, _R_INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


def utf8(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one UTF-8 byte array, and the offset where each starts (one more at the end)."""
    parts = [(x or "").encode("utf-8", "surrogatepass") for x in texts]
    offsets = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return np.frombuffer(b"".join(parts), np.uint8), offsets


def slices(texts: list) -> Iterator[tuple[int, int]]:
    """Bounds of slices of whole texts, each of some ``2 * SLICE_BYTES`` characters or one text."""
    begin = size = 0
    for i, x in enumerate(texts):
        n = len(x or "")
        if size and size + n > 2 * SLICE_BYTES:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of each text (A-Z in lower case), and the words' bounds by text.

    Text ``i`` has the words ``bounds[i]:bounds[i + 1]``. No Python object is made per word: a
    polynomial hash of each word is a difference of prefix sums. Memory is some 50 bytes a byte of
    one slice; slices of whole texts are cut at about half a MB.
    """
    out, counts = [], np.zeros(len(offsets), np.int64)
    i = 0
    while i < len(offsets) - 1:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, "right")) - 1)
        part = _LOWER[data[offsets[i] : offsets[j]]]
        n = len(part)
        word = ~_BLANK[part]
        first = np.zeros(n + 1, bool)
        first[offsets[i:j] - offsets[i]] = True
        starts = word.copy()
        starts[1:] &= ~word[:-1] | first[1:n]
        ends = word.copy()
        ends[:-1] &= ~word[1:] | first[1:n]
        starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        up, down = _power(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[part] * up[:n], out=sums[1:])
        out.append(mix((sums[ends] - sums[starts]) * down[starts]))
        counts[i + 1 : j + 1] = np.searchsorted(starts, offsets[i + 1 : j + 1] - offsets[i]) - np.searchsorted(starts, offsets[i:j] - offsets[i])
        i = j
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.cumsum(counts)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of each text, repeats included, and the shingles' bounds.

    A text with fewer words than ``size`` has one shingle of all its words; one without words has none.
    """
    n = np.diff(bounds)
    counts = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    out_bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    if not len(words):
        return np.zeros(0, np.uint64), out_bounds
    at = np.repeat(bounds[:-1] - out_bounds[:-1], counts) + np.arange(out_bounds[-1])
    last = np.repeat(bounds[1:], counts)
    h = np.full(len(at), 0x51_7C_C1_B7, np.uint64)
    for k in range(size):
        here = at + k
        h = np.where(here < last, mix(h * np.uint64(31) + words[np.minimum(here, len(words) - 1)]), h)
    return h, out_bounds


def runs_of(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 4096) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by ``keys`` as tables of whole runs of equal keys, with the runs' bounds; some ``least`` rows or one run."""
    held: list[pa.RecordBatch] = []

    def cuts_of(table: pa.Table) -> np.ndarray:
        fresh = np.ones(len(table), bool)
        for k in keys:
            x = table[k].to_numpy()
            fresh[1:] &= x[1:] == x[:-1]
        fresh[1:] = ~fresh[1:]
        return np.append(np.flatnonzero(fresh), len(table))

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < least and sum(b.nbytes for b in held) < BATCH_BYTES:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        cuts = cuts_of(table)
        if len(cuts) > 2:
            yield table.slice(0, cuts[-2]), cuts[:-1]
        held = table.slice(cuts[-2]).to_batches()
    table = pa.Table.from_batches(held) if held else None
    if table is not None and len(table):
        yield table.combine_chunks(), cuts_of(table)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; whoever owns that folder clears it."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a table that this library wrote and needs no more."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
