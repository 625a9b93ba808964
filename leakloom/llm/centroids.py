"""Clusters of integer vectors by partial-distance search.

Components become integers ``floor(64 * x)``; sixteen vectors, those with the smallest SHA-256 of their
id, are the first centroids. A round is one narrow pass over the table: each task assigns its vectors and
gives counts and sums by centroid, which Spark adds up; a few hundred numbers reach the driver. Nothing but the final
assignment is ever written.

A vector's squared distance is accumulated over the dimensions of highest variance first. The centroid
that is nearest in the first dimensions gives the bound; any other is abandoned once its part of the distance is
strictly above it, and survivors finish all dimensions. Since only what is strictly farther is dropped and
all arithmetic is exact, results equal a full search, ties (to the smaller number) included. Variances come from the round
before, in the first round from the centroids; they set the order of work only.

Defined cases: vectors that are null, hold null or non-finite components, or haven't 64 components are
left out; with fewer than sixteen there are fewer centroids; equal hashes (rows that repeat an id) are
ordered by their components, null ids come last, and such rows are vectors of their own; components of any size are exact, and distances or
sums beyond a long are given as the largest long; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lattice
from .common import checkpointed

DIM, CLUSTERS, ROUNDS, SCALE, SEED = 64, 16, 3, 64, 1
#: Dimensions that are added at a time.
STRIDE = 8
SCHEMA = "vec_id long, cluster int, distance long"


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance) of each row, and how many components were looked at."""
    parts = [order[k : k + STRIDE] for k in range(0, len(order), STRIDE)]
    part = lattice.squares(x[:, None, parts[0]], centroids[None, :, parts[0]])
    cluster = part.argmin(1)
    best = lattice.squares(x, centroids[cluster])
    alive = lattice.true(part <= best[:, None])
    alive[np.arange(len(x)), cluster] = False
    row, other = np.nonzero(alive)
    far, looked = part[row, other], part.size * len(parts[0]) + x.size
    for own in parts[1:]:
        far = far + lattice.squares(x[row[:, None], own], centroids[other[:, None], own])
        looked += len(row) * len(own)
        on = lattice.true(far <= best[row])
        row, other, far = row[on], other[on], far[on]
    for c in np.unique(other):
        mine = other == c
        at, d = row[mine], far[mine]
        better = lattice.true(d < best[at]) | (lattice.true(d == best[at]) & (c < cluster[at]))
        best[at[better]], cluster[at[better]] = d[better], c
    return cluster, best, looked


def _assigned(batch: pa.RecordBatch, centroids: np.ndarray, order: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, their integers, cluster, distance) of a batch."""
    for at, x in lattice.by_size(lattice.matrix(batch.column("embedding"), DIM), SCALE, centroids):
        cluster, distance, _ = nearest(x, centroids, order)
        yield at, x, cluster, distance


def _moved(vectors: DataFrame, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The centroids after a round, and the dimensions by falling variance."""
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice.Sums(k + 1, DIM)  # the last cell has sums of squares
        for batch in lattice.steps(batches):
            for _, x, cluster, _ in _assigned(batch, centroids, order):
                own.add(cluster, x)
                own.add(np.full(len(x), k), x * x)
        if rows := own.rows():
            yield pa.RecordBatch.from_arrays([pa.array(rows, lattice.CELL_ARROW)], ["own"])

    found = lattice.totals(vectors.select("embedding").mapInArrow(run, f"own {lattice.CELL}").select("own.*"), DIM)
    n, squares = found.pop(k)
    sums = [sum(s) for s in zip(*(s for _, s in found.values()))]
    spread = [n * b - a * a for a, b in zip(sums, squares)]
    return lattice.means(centroids, found), np.array(sorted(range(DIM), key=lambda i: (-spread[i], i)))


def cluster(vectors: DataFrame) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part."""
    kept = vectors.where(lattice.whole() & (F.size("embedding") == DIM)).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    by_hash = F.sha2(F.concat(F.lit(f"{SEED}:"), F.col("vec_id").cast("string")), 256)
    seeds = kept.orderBy(by_hash.asc_nulls_last(), "embedding").limit(CLUSTERS).select("embedding").collect()
    if not seeds:
        return vectors.sparkSession.createDataFrame([], f"{SCHEMA}, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = lattice.array_of(lattice.floors(np.array([r[0] for r in seeds], np.float64), SCALE).tolist())
    order = np.argsort(-np.var(lattice.floats(centroids), axis=0), kind="stable")
    for _ in range(ROUNDS):
        centroids, order = _moved(kept, centroids, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lattice.steps(batches):
            for at, _, own, distance in _assigned(batch, centroids, order):
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(at)), pa.array(own, pa.int32()), pa.array(lattice.longs(distance), pa.int64())], ["vec_id", "cluster", "distance"])

    # Written once, 20 bytes a vector: the sums need all of it before any row is whole.
    found = checkpointed(kept.mapInArrow(run, SCHEMA))
    inertia = {c: int(s) for c, s in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    per = [min(inertia.get(c, 0), lattice.LONG) for c in range(len(centroids))]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    at = F.col("cluster") + 1
    return found.select(
        "*",
        F.element_at(F.array(*(F.lit(v).cast("long") for v in per)), at).alias("cluster_inertia"),
        F.lit(min(sum(inertia.values()), lattice.LONG)).cast("long").alias("inertia"),
        F.element_at(F.array(*map(F.lit, names)), at).alias("centroid_sha256"),
    )
