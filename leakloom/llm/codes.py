"""Compressed vector codes: product codebooks learnt by Yinyang Lloyd.

Components become integers ``floor(4096 * x)`` and vectors are cut into eight parts; each part has a
codebook of sixteen entries, and a vector's code is the nearest entry of each part. The entries of a codebook are clustered
into groups once. A vector's part carries its entry and, for every group, a lower bound of the distance to
the group's other entries. When entries have moved, the bounds fall by the largest drift in their group, and
only groups whose bound doesn't exceed the exact distance to the own entry are scanned. Bounds are rounded
down and what they can't rule out, ties included, is compared as exact integers, so codes equal a full search's.

A round is one narrow pass: it reads the table of the round before (vectors and bounds, 136 bytes a vector), writes its
own to the shared folder, and each task adds one row with counts and sums of its parts by entry, which Spark
adds up over that column alone. A table is deleted once the next is whole, so two at most are there.

Defined cases: vectors that are null or hold null or non-finite components are left out; so are those whose length isn't
that of the vector with the smallest id among those of a length that eight divides (none is zero). With fewer than
sixteen vectors there are fewer entries; rows that repeat an id are vectors of their own, ordered by components; null ids come last; null labels are one label;
components of any size are exact, and errors beyond a long are given as the largest long; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lattice
from .common import delete_path, shared_path

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
GROUPS = 4
#: Relative slack of bounds, far above the rounding of single precision.
SLACK = 1e-6
Codebooks = list[np.ndarray]


def grouped(codebook: np.ndarray) -> list[np.ndarray]:
    """The entries' numbers in at most ``GROUPS`` groups of near entries, each ascending."""
    x = lattice.floats(codebook)
    centres = x[:1]
    while len(centres) < min(GROUPS, len(x)):
        away = ((x[:, None] - centres[None]) ** 2).sum(2).min(1)
        centres = np.concatenate([centres, x[[away.argmax()]]])
    for _ in range(5):
        own = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        centres = np.stack([x[own == g].mean(0) if (own == g).any() else c for g, c in enumerate(centres)])
    own = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
    return [np.flatnonzero(own == g) for g in np.unique(own)]


def drifts(old: np.ndarray, new: np.ndarray, groups: list[np.ndarray]) -> np.ndarray:
    """The largest move of an entry in each group, rounded up; nothing where bounds aren't kept."""
    if old.dtype == object or new.dtype == object:
        return np.zeros(len(groups))
    moved = np.sqrt(((new.astype(float) - old.astype(float)) ** 2).sum(1)) * (1 + SLACK)
    return np.array([moved[g].max() for g in groups])


def reassign(x: np.ndarray, codebook: np.ndarray, groups: list[np.ndarray], entry: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(entry, squared distance, bounds by group) of each row, and how many distances were computed.

    ``entry`` is the entry before, ``low`` the bounds after the entries' drift (minus infinity: unknown).
    """
    own = lattice.squares(x, codebook[entry])
    exact = x.dtype == object or codebook.dtype == object
    reach = np.full(len(x), np.inf) if exact else np.sqrt(own.astype(float)) * (1 + SLACK)
    best, new, scanned, computed = own.copy(), entry.copy(), [], len(x)
    for g, members in enumerate(groups):
        at = np.flatnonzero(low[:, g] <= reach)
        d = lattice.squares(x[at][:, None], codebook[members][None])
        computed += d.size
        scanned.append((at, d))
        if len(at):
            nearest = d.argmin(1)
            least, name = d[np.arange(len(at)), nearest], members[nearest]
            better = lattice.true(least < best[at]) | (lattice.true(least == best[at]) & (name < new[at]))
            best[at[better]], new[at[better]] = least[better], name[better]
    if exact:
        return new, best, np.full(low.shape, -np.inf), computed
    for g, members in enumerate(groups):
        at, d = scanned[g]
        others = np.where(members[None] == new[at][:, None], np.inf, d.astype(float))
        left = (new != entry) & np.isin(entry, members)
        low[left, g] = np.minimum(low[left, g], np.sqrt(own[left].astype(float)) * (1 - SLACK))
        low[at, g] = np.sqrt(others.min(1)) * (1 - SLACK)
    return new, best, low, computed


def _state(column: pa.Array, n: int, groups: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(entry, bounds) of each row and part."""
    if column.null_count:
        return np.zeros((n, PARTS), np.uint8), np.full((n, PARTS, GROUPS), -np.inf, np.float32)
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(n, PARTS * (1 + 4 * GROUPS))
    return raw[:, :PARTS], np.ascontiguousarray(raw[:, PARTS:]).view(np.float32).reshape(n, PARTS, GROUPS)


def _coded(batch: pa.RecordBatch, dim: int, codebooks: Codebooks, groups: list[list[np.ndarray]], drift: list[np.ndarray]) -> Iterator[tuple]:
    """(rows, their integers, entry by part, error, bounds) of a batch."""
    wide = dim // PARTS
    before, bounds = _state(batch.column("state"), batch.num_rows, groups)
    for at, x in lattice.by_size(lattice.matrix(batch.column("embedding"), dim), SCALE, np.concatenate(codebooks)):
        entry, error = np.zeros((len(at), PARTS), np.uint8), np.zeros(len(at), x.dtype)
        low = np.full((len(at), PARTS, GROUPS), np.inf, np.float32)
        for p in range(PARTS):
            g = len(groups[p])
            fallen = bounds[at, p, :g].astype(float) * (1 - SLACK) - drift[p]
            own, d, fallen, _ = reassign(x[:, p * wide : (p + 1) * wide], codebooks[p], groups[p], before[at, p].astype(int), fallen)
            entry[:, p], error, low[:, p, :g] = own, error + d, fallen
        yield at, x, entry, error, low


def _moved(table: DataFrame, dim: int, codebooks: Codebooks) -> Codebooks:
    """The codebooks after a round whose table is written."""
    cells = table.where(F.col("sums").isNotNull()).select(F.explode("sums").alias("s")).select("s.*")
    found = lattice.totals(cells, dim // PARTS)
    return [lattice.means(c, found, p * ENTRIES) for p, c in enumerate(codebooks)]


def _round(table: DataFrame, dim: int, codebooks: Codebooks, groups: list, drift: list) -> DataFrame:
    wide = dim // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice.Sums(PARTS * ENTRIES, wide)
        names = ["vec_id", "label", "embedding", "state", "sums"]
        kinds = None
        for batch in lattice.steps(batches):
            kinds = [batch.schema.field(n).type for n in names[:3]]
            for at, x, entry, _, low in _coded(batch, dim, codebooks, groups, drift):
                for p in range(PARTS):
                    own.add(entry[:, p].astype(int), x[:, p * wide : (p + 1) * wide], p * ENTRIES)
                state = [e.tobytes() + b.tobytes() for e, b in zip(entry, low)]
                part = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names[:3]), pa.array(state, pa.binary()), pa.nulls(len(at), pa.list_(lattice.CELL_ARROW))], names)
        if kinds:
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, k) for k in kinds), pa.nulls(1, pa.binary()), pa.array([own.rows()], pa.list_(lattice.CELL_ARROW))], names)

    types = dict(table.dtypes)
    return table.select("vec_id", "label", "embedding", "state").mapInArrow(run, f"vec_id {types['vec_id']}, label {types['label']}, embedding {types['embedding']}, state binary, sums array<{lattice.CELL}>")


def compress(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every vector that takes part."""
    spark = vectors.sparkSession
    kept = vectors.where(lattice.whole()).select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    cut = kept.where((F.size("embedding") > 0) & (F.size("embedding") % PARTS == 0))
    first = lambda rows: [r[0] for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(ENTRIES).select("embedding").collect()]
    seeds = first(cut)
    if not seeds:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    dim = len(seeds[0])
    kept = cut.where(F.size("embedding") == dim)
    if any(len(s) != dim for s in seeds):
        seeds = first(kept)
    whole = lattice.floors(np.array(seeds, np.float64), SCALE)
    codebooks = [lattice.array_of(part.tolist()) for part in np.split(whole, PARTS, axis=1)]
    groups = [grouped(c) for c in codebooks]
    drift = [np.zeros(len(g)) for g in groups]

    folder, table = shared_path(spark, "codes"), kept.withColumn("state", F.lit(None).cast("binary"))
    for k in range(ROUNDS):
        _round(table, dim, codebooks, groups, drift).write.parquet(f"{folder}/{k}")
        if k:
            delete_path(spark, f"{folder}/{k - 1}")
        written = spark.read.parquet(f"{folder}/{k}")
        moved = _moved(written, dim, codebooks)
        drift = [drifts(a, b, g) for a, b, g in zip(codebooks, moved, groups)]
        codebooks, table = moved, written.where(F.col("state").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lattice.steps(batches):
            for at, _, entry, error, _ in _coded(batch, dim, codebooks, groups, drift):
                part = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), pa.array([e.tobytes().hex() for e in entry]), pa.array(lattice.longs(error), pa.int64())], ["vec_id", "label", "code", "error"])

    coded = table.select("vec_id", "label", "embedding", "state").mapInArrow(run, f"vec_id long, label {dict(table.dtypes)['label']}, code string, error long")
    coded.write.parquet(f"{folder}/coded")
    delete_path(spark, f"{folder}/{ROUNDS - 1}")
    coded = spark.read.parquet(f"{folder}/coded")
    per = coded.groupBy(F.col("label").alias("__label")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(lattice.LONG)).cast("long").alias("label_error"))
    digest = hashlib.sha256(",".join(str(v) for c in codebooks for v in c.ravel().tolist()).encode()).hexdigest()
    joined = coded.join(per, F.col("label").eqNullSafe(F.col("__label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
