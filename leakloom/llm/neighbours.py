"""Approximate nearest neighbours by cross-polytope hashing.

A unit vector, padded with zeros to a power of two, is turned by a pseudo-rotation (three rounds of random signs and
a fast Hadamard transform) and hashed to its nearest signed axis. A table's bucket is the axes of several such
rotations, the last one over its first coordinates only, so that a bucket has some thousands of vectors whatever the
table's size (``BUCKET``). Every vector is in one bucket of each of ``TABLES`` tables; a query probes, in each, the buckets whose axes it is nearest to.
How many follows from the number of vectors alone (``plan``): pairs at the cosine that the fifth neighbour has among
that many random vectors are simulated, and the fewest probes are taken that find ``RECALL`` of them. Random
vectors are the hard case: neighbours in real tables are closer. Measured against brute force on the given
tables: see the tests and the README.

Equal vectors are one node with its smallest ids, so copies are never compared with one another. A bucket's
members and the queries that probe it are cut into chunks of ``CHUNK``; a task holds one chunk of each, compares them
as matrices, recomputes the best exactly and gives each query's five nearest nodes of it, ties to smaller ids: nothing
that could be among the five nearest found is dropped. Those are merged by query.

Cost: rows to shuffle are ``TABLES`` per vector and ``TABLES`` times probes per query. Where distinct vectors lie so
close that a bucket has many chunks, its queries meet each of them; the work there is queries times members.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part; vectors of
different length aren't compared; finite vectors whose squares leave double precision are scaled by their largest
component first; equal vectors are candidates of each other; a repeated id is a row of its own, as query and as candidate; a
row with a null id is no query, but a candidate, after the ids at ties; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import lattice
from .common import checkpointed
from .embeddings import _packed as packed
from .embeddings import _unpacked as unpacked

NEAREST = 5
TABLES = 4
#: Vectors that a bucket should have: the square root of their number, between these.
BUCKET = (2048, 8192)
#: The most vectors that one task compares with as many queries.
CHUNK = 8192
RECALL = 0.98
SEED = 11
NODE = "dim int, key binary"


def _hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Hadamard transform of each row, whose length is a power of two; not normalised."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2)
        h *= 2
    return x.reshape(n, d)


def padded(dim: int) -> int:
    """The length that vectors are padded to: a power of two, eight at least."""
    return max(8, 1 << (dim - 1).bit_length())


@lru_cache(1024)
def _signs(size: int, table: int, turn: int) -> np.ndarray:
    return np.random.default_rng([SEED, size, table, turn]).choice([-1.0, 1.0], (3, size))


def turned(unit: np.ndarray, table: int, turn: int, axes: int) -> np.ndarray:
    """Each unit vector's inner products with the signed axes of a pseudo-rotation: the first ones, then their opposites."""
    size = padded(unit.shape[1])
    x = np.zeros((len(unit), size))
    x[:, : unit.shape[1]] = unit
    for signs in _signs(size, table, turn):
        x = _hadamard(x * signs) / np.sqrt(size)
    return np.concatenate([x[:, :axes], -x[:, :axes]], 1)


def _fifth(n: int, dim: int) -> float:
    """The cosine that the fifth neighbour of a vector has among ``n`` random ones."""
    t = np.linspace(-1, 1, 20001)[1:-1]
    density = (1 - t * t) ** ((max(dim, 3) - 3) / 2)
    above = np.cumsum(density[::-1])[::-1] / density.sum()
    return float(t[min(np.searchsorted(-above, -NEAREST / n), len(t) - 1)])


@lru_cache(64)
def plan(n: int, dim: int) -> tuple[tuple[int, ...], int]:
    """(axes of each rotation, buckets that a query probes in a table) for ``n`` vectors, rounded up to a power of two."""
    n = max(16, 1 << (n - 1).bit_length())
    size, wanted, axes = padded(dim), max(8, n // min(BUCKET[1], max(BUCKET[0], int(n**0.5)))), []
    while wanted > 1:
        axes.append(min(size, max(1, 1 << (-(-wanted // 2) - 1).bit_length())))
        wanted = -(-wanted // (2 * axes[-1]))
    rng = np.random.default_rng([SEED, dim])
    pairs = 2000 if len(axes) < 3 else 200
    q, other = (rng.standard_normal((pairs, dim)) for _ in range(2))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    other -= (other * q).sum(1, keepdims=True) * q
    size_of = np.linalg.norm(other, axis=1, keepdims=True)
    cosine = _fifth(n, dim)
    x = cosine * q + np.sqrt(1 - cosine * cosine) * other / np.where(size_of > 1e-9, size_of, 1)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    buckets = int(np.prod([2 * a for a in axes]))
    best = np.full(pairs, buckets)
    for table in range(TABLES):
        near = [turned(q, table, k, a) for k, a in enumerate(axes)]
        mine = sum(s[np.arange(pairs), turned(x, table, k, a).argmax(1)] for k, (s, a) in enumerate(zip(near, axes)))
        last = np.sort(near[-1], 1)
        for i in range(pairs):
            sums = np.zeros(1)
            for s in near[:-1]:
                sums = (sums[:, None] + s[i][None]).ravel()
            # The rank of the other's bucket: how many tuples of axes are at least as near to the query.
            best[i] = min(best[i], int((last.shape[1] - np.searchsorted(last[i], mine[i] - sums - 1e-12)).sum()))
    return tuple(axes), int(np.sort(best)[min(pairs - 1, int(np.ceil(RECALL * pairs)))])


def buckets(unit: np.ndarray, table: int, axes: tuple[int, ...]) -> np.ndarray:
    """The bucket of each unit vector."""
    out = np.zeros(len(unit), np.int64)
    for k, a in enumerate(axes):
        out = out * 2 * a + turned(unit, table, k, a).argmax(1)
    return out


def probes(unit: np.ndarray, table: int, axes: tuple[int, ...], most: int) -> np.ndarray:
    """The ``most`` buckets that each unit vector is nearest to, nearest first."""
    rows = max(1, (1 << 21) // (most * 2 * max(axes)))
    if len(unit) > rows:
        return np.concatenate([probes(unit[lo : lo + rows], table, axes, most) for lo in range(0, len(unit), rows)])
    name, sums = np.zeros((len(unit), 1), np.int64), np.zeros((len(unit), 1))
    for k, a in enumerate(axes):
        near = turned(unit, table, k, a)
        # Of a prefix of axes only the best can be in the best tuples.
        sums = (sums[:, :, None] + near[:, None, :]).reshape(len(unit), -1)
        name = (name[:, :, None] * 2 * a + np.arange(2 * a)).reshape(len(unit), -1)
        best = np.argsort(-sums, 1, kind="stable")[:, :most]
        name, sums = np.take_along_axis(name, best, 1), np.take_along_axis(sums, best, 1)
    return name


def _usable(v: list | None) -> np.ndarray | None:
    if not v or any(x is None for x in v):
        return None
    a = np.asarray(v, np.float64)
    return a if np.isfinite(a).all() and a.any() else None


def _within_reach(x: np.ndarray) -> np.ndarray:
    """Rows scaled by their largest component where squares would overflow or vanish."""
    top = np.abs(x).max(1, keepdims=True)
    return np.where((top > 1e-100) & (top < 1e100), x, x / top)


def _units(x: np.ndarray) -> np.ndarray:
    x = _within_reach(x)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine of each row of ``a`` with that of ``b``, the same wherever the pair is met."""
    a, b = _within_reach(a), _within_reach(b)
    return (a * b).sum(1) / np.sqrt((a * a).sum(1)) / np.sqrt((b * b).sum(1))


def _prepared(vectors: DataFrame) -> DataFrame:
    """(vec_id, dim, key, data, self) of the vectors that take part; equal vectors have equal keys, ``self`` is their cosine as computed."""
    rows = vectors.where(lattice.whole()).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lattice.steps(batches):
            own = [(i, a) for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if (a := _usable(v)) is not None]
            data = [packed(a + 0.0) for _, a in own]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in own], pa.int64()), pa.array([len(a) for _, a in own], pa.int32()), pa.array([hashlib.blake2b(d, digest_size=16).digest() for d in data], pa.binary()), pa.array(data, pa.binary()), pa.array([float(cosines(a[None], a[None])[0]) for _, a in own], pa.float64())], ["vec_id", "dim", "key", "data", "self"])

    return rows.mapInArrow(run, f"vec_id long, {NODE}, data binary, self double")


def _nodes(prepared: DataFrame) -> DataFrame:
    """(dim, key, data, self, ids) of distinct vectors; ``ids`` are the smallest of theirs, one more than a query has neighbours."""
    place = F.row_number().over(Window.partitionBy("dim", "key").orderBy(F.col("vec_id").asc_nulls_last()))
    first = prepared.withColumn("place", place).where(F.col("place") <= NEAREST + 1)
    return first.groupBy("dim", "key").agg(F.any_value("data").alias("data"), F.any_value("self").alias("self"), F.transform(F.array_sort(F.collect_list(F.struct("place", "vec_id"))), lambda x: x["vec_id"]).alias("ids"))


def _hashed(nodes: DataFrame, asked: bool) -> DataFrame:
    """A row for each bucket that a node is in, or that it probes as a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lattice.steps(batches):
            dims, n = batch.column("dim").to_numpy(), batch.column("n").to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                axes, most = plan(int(n[at[0]]), int(dim))
                part = batch.take(pa.array(at))
                unit = _units(unpacked(part.column("data").to_pylist(), int(dim)))
                for table in range(TABLES):
                    own = probes(unit, table, axes, most) if asked else buckets(unit, table, axes)[:, None]
                    row = np.repeat(np.arange(len(at)), own.shape[1])
                    for lo in range(0, len(row), lattice.ROWS):
                        some = part.take(pa.array(row[lo : lo + lattice.ROWS]))
                        fields = [some.column(c) for c in ("dim", "key", "data", "least")]
                        yield pa.RecordBatch.from_arrays([*fields, pa.array(np.full(some.num_rows, table), pa.int32()), pa.array(own.ravel()[lo : lo + lattice.ROWS], pa.int64())], ["dim", "key", "data", "least", "hash", "bucket"])

    rows = nodes.select("dim", "key", "data", F.coalesce(F.col("ids")[0], F.lit(lattice.LONG)).alias("least"), "n")
    return rows.mapInArrow(run, f"{NODE}, data binary, least long, hash int, bucket long")


def _best(block: pd.DataFrame) -> pd.DataFrame:
    """(dim, key, node, score) of each query's nearest nodes in a block of members and queries of a bucket."""
    asked = block["asked"].to_numpy()
    dim, keys, least = int(block["dim"].iloc[0]), block["key"].to_numpy(), block["least"].to_numpy()
    number = pd.factorize(keys)[0]
    x = unpacked(block["data"].tolist(), dim)
    unit = _units(x)
    members, found = np.flatnonzero(~asked), []
    if len(members):
        for query in np.array_split(np.flatnonzero(asked), -(-int(asked.sum()) // 256)):
            score = unit[query] @ unit[members].T
            score[number[query][:, None] == number[members][None]] = -np.inf
            k = min(NEAREST, len(members))
            # Room for the rounding of the product, beyond which the exact cosines decide.
            row, col = np.nonzero(score >= np.maximum(np.partition(score, -k, axis=1)[:, -k], -2)[:, None] - 1e-9)
            exact = cosines(x[query[row]], x[members[col]])
            order = np.lexsort((least[members[col]], -exact, row))
            row, col, exact = row[order], col[order], exact[order]
            first = np.searchsorted(row, np.arange(len(query)))
            on = np.arange(len(row)) - first[row] < NEAREST
            found.append(pd.DataFrame({"dim": dim, "key": keys[query[row[on]]], "node": keys[members[col[on]]], "score": exact[on]}))
    return pd.concat(found) if found else pd.DataFrame({"dim": pd.Series([], "int32"), "key": [], "node": [], "score": pd.Series([], "float64")})


def _candidates(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """(dim, key, node, score): of each bucket chunk that a query probes, its nearest nodes."""
    where = ["dim", "hash", "bucket"]
    index, asked = _hashed(nodes, False), _hashed(queries, True)
    chunks = lambda rows, name: rows.groupBy(*where).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias(name))
    # Buckets that nothing is in, or that no query probes, go here.
    sizes = chunks(index, "members").join(chunks(asked, "queries"), where)

    def dealt(rows: DataFrame, own: str, others: str, first: str, second: str) -> DataFrame:
        mine = F.pmod(F.xxhash64("key"), F.col(own)).cast("int").alias(first)
        return rows.join(sizes, where).select(*where, "key", "data", "least", mine, F.explode(F.sequence(F.lit(0), F.col(others) - 1)).alias(second))

    members = dealt(index, "members", "queries", "i", "j").select("*", F.lit(False).alias("asked"))
    blocks = members.unionByName(dealt(asked, "queries", "members", "j", "i").select("*", F.lit(True).alias("asked")))
    return blocks.groupBy(*where, "i", "j").applyInPandas(_best, f"{NODE}, node binary, score double")


def search(vectors: DataFrame, is_query: Column | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of each query; by default, ids that 50 divides are queries."""
    is_query = F.col("vec_id") % 50 == 0 if is_query is None else is_query
    nodes = checkpointed(_nodes(_prepared(vectors)))
    sized = nodes.join(nodes.groupBy("dim").agg(F.count("*").alias("n")), "dim")
    asking = _prepared(vectors.where(is_query & F.col("vec_id").isNotNull())).select("vec_id", "dim", "key")
    queries = sized.join(asking.select("dim", "key").distinct(), ["dim", "key"], "left_semi")
    # A pair is met once for each table that finds it.
    met = _candidates(sized, queries).groupBy("dim", "key", "node").agg(F.max("score").alias("score"))
    member = nodes.select("dim", F.col("key").alias("node"), "ids", F.coalesce(F.col("ids")[0], F.lit(lattice.LONG)).alias("least"))
    by_near = Window.partitionBy("dim", "key").orderBy(F.desc("score"), "least")
    nearest = met.join(member, ["dim", "node"]).withColumn("place", F.row_number().over(by_near)).where(F.col("place") <= NEAREST)
    # A query's own node comes besides: its copies are candidates, at a cosine computed like any other.
    copies = queries.where(F.size("ids") > 1).select("dim", "key", F.col("key").alias("node"), F.col("self").alias("score"), "ids")
    lists = nearest.select("dim", "key", "node", "score", "ids").unionByName(copies).groupBy("dim", "key").agg(F.collect_list(F.struct("node", "score", "ids")).alias("found"))
    own = asking.join(lists, ["dim", "key"]).select(F.col("vec_id").alias("query_id"), _ranked(F.col("found"), F.col("key"), F.col("vec_id")).alias("found"))
    return own.select("query_id", F.posexplode("found").alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def _ranked(found: Column, key: Column, query: Column) -> Column:
    """The first candidates of a query's nodes: nearest first, then smaller ids; of its own node's ids, its own goes once."""
    ids = lambda x: F.when(x["node"] == key, F.filter(x["ids"], lambda i, k: k + 1 != F.array_position(x["ids"], query))).otherwise(x["ids"])
    each = F.flatten(F.transform(found, lambda x: F.transform(ids(x), lambda i: F.struct((-x["score"]).alias("far"), F.coalesce(i, F.lit(lattice.LONG)).alias("order"), i.alias("vec_id"), x["score"].alias("score")))))
    return F.slice(F.array_sort(each), 1, NEAREST)
