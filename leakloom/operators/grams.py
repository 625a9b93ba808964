"""Which texts a new or changed detector must be run on: hashed grams of four bytes of every text, as bits.

``index`` has a row for each text that a scan looks into, with the grams of its lower-case form and of its base64 payloads,
eight bits or more for each distinct one. The bits lie in 16 columns by the first four bits of the hash, so a keyword is looked up in the few
columns that its own grams are in, and Parquet reads no other. ``candidates`` are the texts that have all grams of one
of the keywords: all that the keywords are in, and some by chance. A keyword shorter than four bytes, and a detector
without keywords, ask for every text. ``detect`` on the candidates gives what it gives on all.

Texts that are null or binary have no row, as a scan gives nothing for them. The index is of contents as they were: new and
changed texts are indexed again, and their old rows left out, by whoever keeps it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import stores
from .detect import _encoded, detect, is_binary, spread
from .registry import Detector

SLICES = tuple(f"bits{k:02d}" for k in range(16))
#: Bytes of text whose grams are made at a time.
CHUNK = 1 << 22
_FACTOR = 2654435761  # a multiplier that spreads the bits of the four bytes over 32


def _hashes(data: bytes) -> np.ndarray:
    """Distinct hashes of the grams of four bytes."""
    out = [np.empty(0, np.uint64)]
    for at in range(0, max(len(data) - 3, 0), CHUNK):
        b = np.frombuffer(data, np.uint8, min(CHUNK + 3, len(data) - at), at).astype(np.uint64)
        gram = b[:-3] | b[1:-2] << np.uint64(8) | b[2:-1] << np.uint64(16) | b[3:] << np.uint64(24)
        out.append(np.unique(gram * np.uint64(_FACTOR) & np.uint64(0xFFFFFFFF)))
    return np.unique(np.concatenate(out))


def _bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogateescape")


def _slices(texts: list[str]) -> list[bytes]:
    hashes = np.unique(np.concatenate([_hashes(_bytes(t)) for t in texts]))
    out = []
    for k in range(16):
        own = hashes[hashes >> np.uint64(28) == k] & np.uint64(0x0FFFFFFF)
        size = 1 << max(3, (8 * len(own) - 1).bit_length()) if len(own) else 8
        bits = np.zeros(size, np.uint8)
        bits[(own * np.uint64(size) >> np.uint64(28)).astype(np.int64)] = 1
        out.append(np.packbits(bits, bitorder="little").tobytes())
    return out


def index(sources: DataFrame) -> DataFrame:
    """(file, commit, bits00 to bits15) of ``sources`` (file, commit, content as text or binary)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, commit, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if content is None or (is_binary(content) if isinstance(content, bytes) else "\0" in content[:8000]):
                    continue
                text = content.decode("utf-8", "surrogateescape") if isinstance(content, bytes) else content
                rows.append((file, commit, *_slices([text, *(x for _, _, x in _encoded([text]))])))
            if rows:
                kinds = [pa.string(), pa.string(), *[pa.binary()] * 16]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["file", "commit", *SLICES])

    rows = sources.select("file", F.coalesce("commit", F.lit("")).alias("commit"), "content")
    return rows.mapInArrow(run, f"file string, commit string, {', '.join(f'{s} binary' for s in SLICES)}")


def _grams(keyword: str) -> tuple[tuple[str, int], ...]:
    """(column, place in 2^28) of a keyword's grams; none for one too short to tell."""
    return tuple((SLICES[g >> 28], g & 0x0FFFFFFF) for g in _hashes(_bytes(keyword)).tolist())


def _has(bits: bytes, place: int) -> bool:
    at = place * (8 * len(bits)) >> 28
    return bool(bits[at >> 3] >> (at & 7) & 1)


def candidates(of: DataFrame, detectors: Iterable[Detector]) -> DataFrame:
    """(file, commit) of the texts that some of the detectors must be run on."""
    asked = sorted({_grams(k) for d in detectors for k in (d.usable_keywords or ("",))})
    if not asked or () in asked:
        return of.where(F.lit(bool(asked))).select("file", "commit")
    columns = sorted({c for grams in asked for c, _ in grams})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = {c: batch.column(2 + k).to_pylist() for k, c in enumerate(columns)}
            keep = [any(all(_has(bits[c][row], place) for c, place in grams) for grams in asked) for row in range(batch.num_rows)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return of.select("file", "commit", *columns).mapInArrow(run, "file string, commit string")


def rescan(sources: DataFrame, of: DataFrame, detectors: tuple[Detector, ...]) -> DataFrame:
    """Findings of the detectors in ``sources``, of which only the index's candidates are looked into."""
    rows = sources.withColumn("commit", F.coalesce("commit", F.lit("")))
    return detect(rows.join(candidates(of, detectors).distinct(), ["file", "commit"], "left_semi"), detectors)


def rescan_files(listed: DataFrame, of: DataFrame, detectors: tuple[Detector, ...]) -> DataFrame:
    """The same for files (path, file, commit): only names are joined, and only candidates are read."""

    def contents(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, file, commit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, name = stores.of(path)
                try:
                    with store.open_input_stream(name) as f:
                        content = f.read()
                except FileNotFoundError:
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([file], pa.string()), pa.array([commit], pa.string()), pa.array([content], pa.binary())], ["file", "commit", "content"])

    own = listed.select("path", "file", "commit").join(candidates(of, detectors).distinct(), ["file", "commit"], "left_semi")
    return detect(spread(own.select("path", "file", "commit")).mapInArrow(contents, "file string, commit string, content binary"), detectors)
