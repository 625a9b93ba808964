"""Near-duplicate embeddings by spherical-cap filters.

A vector is rotated and cut into blocks; each block has a small random code of unit vectors, and
every tuple of code words is a filter direction. List decoding finds all directions whose inner
product with the vector exceeds a threshold, block by block, dropping tuples that can't reach it.
Vectors of a label are compared inside each filter that two of them share; every candidate is checked
by its cosine in double precision. There are three independent codes, each with a threshold that is
measured: of sampled pairs at a cosine of exactly 0.93 it brings 90 % together, so all three bring 99.9 %
(held in the tests; closer pairs more often). Codes grow with the label: words are counted so that a filter has
some ``MEMBERS`` of its vectors, 64 words a block (4096 filters) for 131,072 vectors, twice the words for up to four
times as many, and so on; smaller labels share the codes that the largest of them needs. A vector is in some 12 filters
of a code of 256, 18 of 4096, 27 of 65,536 and 33 of a million, so rows and comparisons grow with the vectors, not with pairs.

Equal vectors of a label are one node with a count. A filter's members are split into chunks of at
most ``CHUNK`` and compared chunk by chunk, so no task holds more than two chunks of a group at a time,
however large it is. Each row carries the list of its node's filters, so a pair counts in its first common
filter only; a block gives a row per member that has links: how many, and the smallest member that
those links reach within the block. So links are counted, but only a forest of them leaves a block.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, and vectors
without a label, link with nothing (0 links, a component of their own); vectors of different length
never link; finite vectors whose squares leave double precision are scaled by their largest component
first; rows that repeat an id are vectors of their own; a null id links like
any vector (and is no component's name); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, checkpointed
from .components import components

LEAST = 0.93
#: Independent codes; two vectors must share a filter in one of them.
TABLES = 3
#: Blocks of a code, the least code words of a block, and the most that labels share.
BLOCKS, WORDS, SHARED = 2, 8, 64
#: Of pairs at a cosine of LEAST, those that one code brings together, and the pairs that this is measured on.
CAUGHT, PROBES = 0.9, 1000
#: Members of a filter that codes are made for; a random vector is in some LIST filters of a code.
MEMBERS, LIST = 512, 16
#: Neighbouring filters that one task call compares, each by itself.
TOGETHER = 8
CHUNK = 1024
SEED = 7


@cache
def code(dim: int, table: int = 0, words: int = WORDS) -> tuple[np.ndarray, tuple[np.ndarray, ...], float]:
    """The rotation, each block's code words (scaled so that tuples are unit vectors), and the threshold.

    The threshold is measured on pairs at a cosine of ``LEAST``: the best filter of a pair is looked for among tuples of
    the 128 words of each block that suit it most, so it is never set too high.
    """
    rng = np.random.default_rng([SEED, dim, table, words])
    rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    blocks = np.array_split(np.arange(dim), min(BLOCKS, dim))
    parts = []
    for own in blocks:
        c = rng.standard_normal((words, len(own)))
        parts.append(c / np.linalg.norm(c, axis=1, keepdims=True) / np.sqrt(len(blocks)))
    best = []
    for _ in range(0, PROBES, 50):
        x, z = rng.standard_normal((2, 50, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z -= (z * x).sum(1, keepdims=True) * x
        y = LEAST * x + np.sqrt(1 - LEAST**2) * z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
        y /= np.linalg.norm(y, axis=1, keepdims=True)
        both = np.zeros((2, 50, 1))
        for own, c in zip(blocks, parts):
            scores = np.stack([x[:, own] @ c.T, y[:, own] @ c.T])
            top = np.argpartition(-scores.sum(0), min(128, words) - 1, 1)[:, :128]
            scores = np.take_along_axis(scores, top[None], 2)
            both = (both[:, :, :, None] + scores[:, :, None, :]).reshape(2, 50, -1)
        best.append(both.min(0).max(1))
    return rotation, tuple(parts), float(np.quantile(np.concatenate(best), 1 - CAUGHT)) - 1e-12


def decode(unit: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of all codes, by row and filter; the filters of a code follow those of the code before."""
    found = [_decode(unit, t, words) for t in range(TABLES)]
    row = np.concatenate([r for r, _ in found])
    own = np.concatenate([f + t * words**BLOCKS for t, (_, f) in enumerate(found)])
    order = np.lexsort((own, row))
    return row[order], own[order]


def _decode(unit: np.ndarray, table: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) for every filter direction that exceeds the threshold; rows are unit vectors.

    A vector that none exceeds is in its best filter, so each is in one at least. Some million sums are held at a time.
    """
    n, dim = unit.shape
    rotation, parts, least = code(dim, table, words)
    x = unit @ rotation.T
    scores = [x[:, own] @ c.T for own, c in zip(np.array_split(np.arange(dim), len(parts)), parts)]
    best = [s.max(1) for s in scores]
    least = np.minimum(least, sum(best) - 1e-12)
    row, tuple_, total = np.arange(n), np.zeros(n, np.int64), np.zeros(n)
    step = max(1, (1 << 20) // words)
    for k, s in enumerate(scores):
        rest = least - sum(best[k + 1 :], np.zeros(n))
        found = []
        for lo in range(0, len(row), step):
            own = row[lo : lo + step]
            reach = total[lo : lo + step, None] + s[own]
            i, j = np.nonzero(reach >= rest[own][:, None])
            found.append((own[i], tuple_[lo + i] * words + j, reach[i, j]))
        if found:
            row, tuple_, total = (np.concatenate(c) for c in zip(*found))
    return row, tuple_


def _usable(v: list | None) -> np.ndarray | None:
    """The vector in double precision, scaled where its square would overflow or vanish; None if it links with nothing."""
    if not v or any(x is None for x in v):
        return None
    a = np.asarray(v, np.float64)
    if not np.isfinite(a).all() or not a.any():
        return None
    top = np.abs(a).max()
    return a if 1e-100 < top < 1e100 else a / top


def _packed(v: np.ndarray) -> bytes:
    """The components as single precision where that is exact, else as double."""
    with np.errstate(over="ignore"):
        single = v.astype(np.float32)
    return (single if (single == v).all() else v).tobytes()


def _unpacked(data: list[bytes], dim: int) -> np.ndarray:
    if all(len(x) == 4 * dim for x in data):
        return np.frombuffer(b"".join(data), np.float32).reshape(-1, dim).astype(np.float64)
    return np.stack([np.frombuffer(x, np.float32 if len(x) == 4 * dim else np.float64).astype(np.float64) for x in data])


def _prepared(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, dim, key, data): the vector's components; null data where it links with nothing."""
    bound_batches(vectors.sparkSession, 2048)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [None if label is None else _usable(v) for label, v in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            data = [None if a is None else _packed(a + 0.0) for a in own]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([0 if a is None else len(a) for a in own], pa.int32()), pa.array([None if d is None else hashlib.blake2b(d, digest_size=16).digest() for d in data], pa.binary()), pa.array(data, pa.binary())], ["vec_id", "label", "dim", "key", "data"])

    return rows.mapInArrow(run, "vec_id long, label string, dim int, key binary, data binary")


def _number(words: int) -> str:
    """How the filters of such codes are written."""
    return "<u2" if TABLES * words**BLOCKS <= 1 << 16 else "<u8"


def _sized(nodes: DataFrame) -> DataFrame:
    """The nodes with the ``words`` of their label's codes.

    Labels that need more than ``SHARED`` words are broadcast, a row of twelve bytes for each 131,072 nodes of the table
    at most; all others have the words that the largest of them needs, one number.
    """
    own = F.xxhash64("label", "dim")  # labels that share a hash share a size of codes, which changes no result
    grown = F.ceil(F.log2(F.sqrt(F.col("count") * F.lit(LIST / MEMBERS)) / WORDS))
    sizes = nodes.groupBy("label", "dim").count()
    sizes = sizes.select(own.alias("own"), F.greatest(F.lit(WORDS), F.lit(WORDS) * F.pow(F.lit(2), grown)).cast("int").alias("words"))
    shared = sizes.where(F.col("words") <= SHARED).agg(F.max("words")).first()[0] or WORDS
    large = sizes.where(F.col("words") > SHARED).groupBy("own").agg(F.max("words").alias("words"))
    return nodes.withColumn("own", own).join(F.broadcast(large), "own", "left").withColumn("words", F.coalesce("words", F.lit(shared)))


def _filtered(nodes: DataFrame) -> DataFrame:
    """A row (node, label, dim, words, copies, data, filters, filter) for each filter that a node is in; ``filters`` has them all."""
    bound_batches(nodes.sparkSession, 1024)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = np.array([batch.column(k).to_pylist() for k in (2, 3)], int).T
            data = batch.column(5).to_pylist()
            for dim, words in np.unique(kinds, axis=0).tolist():
                at = np.flatnonzero((kinds == (dim, words)).all(1))
                x = _unpacked([data[i] for i in at], dim)
                row, own = decode(x / np.linalg.norm(x, axis=1, keepdims=True), words)
                cuts = np.searchsorted(row, np.arange(len(at) + 1))
                lists = pa.array([own[a:b].astype(_number(words)).tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())
                for lo in range(0, len(row), 4096):
                    part = row[lo : lo + 4096]
                    yield pa.RecordBatch.from_arrays([*batch.take(pa.array(at[part])).columns, lists.take(pa.array(part)), pa.array(own[lo : lo + 4096], pa.int64())], ["node", "label", "dim", "words", "copies", "data", "filters", "filter"])

    return nodes.select("node", "label", "dim", "words", "copies", "data").mapInArrow(run, "node long, label string, dim int, words int, copies long, data binary, filters binary, filter long")


def _first_common(row: np.ndarray, ids: np.ndarray, n: int, a: np.ndarray, b: np.ndarray, own: int) -> np.ndarray:
    """Of pairs (a, b) of ``n`` rows that share the filter ``own``, those that share none before it; row ``row[k]`` is in ``ids[k]``.

    Filters that two of the pairs' rows are in become bits, the commonest first.
    """
    here = np.arange(len(a))
    asked = np.zeros(n, bool)
    asked[a] = asked[b] = True
    before = asked[row] & (ids < own)
    row, (ids, at, counts) = row[before], np.unique(ids[before], return_inverse=True, return_counts=True)
    place = np.empty(len(ids), np.int64)
    place[np.argsort(-counts, kind="stable")] = np.arange(len(ids))
    width = -(-int((counts > 1).sum()) // 64)
    shared = counts[at] > 1
    row, bit = row[shared], place[at[shared]]
    bits = np.zeros((n, width), np.uint64)
    np.bitwise_or.at(bits, (row, bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    for lo in range(0, width, 4):
        apart = []
        for k in range(0, len(here), 1 << 16):
            part = here[k : k + (1 << 16)]
            apart.append(part[~(bits[a[part], lo : lo + 4] & bits[b[part], lo : lo + 4]).any(1)])
        here = np.concatenate(apart) if apart else here
        if not len(here):
            break
    return here


def _reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of ``n`` members that each one's links (a, b) reach."""
    low = np.arange(n)
    while len(a):
        m = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        new = new[new]
        if (new == low).all():
            break
        low = new
    return low


def _within(block: pd.DataFrame) -> pd.DataFrame:
    """(node, more, low) of the members of a block that have links first found in it, filter by filter.

    A block has all of one chunk of each of its filters, or two chunks that are compared across;
    ``more`` counts the vectors linked, ``low`` is the first member that the links reach.
    """
    block = block.sort_values(["filter", "node"])
    x = _unpacked(block["data"].tolist(), int(block["dim"].iloc[0]))
    norm = np.sqrt((x * x).sum(1))
    node, chunk, own, copies = (block[c].to_numpy() for c in ("node", "chunk", "filter", "copies"))
    kind = np.dtype(_number(int(block["words"].iloc[0])))
    starts = np.concatenate([[0], np.cumsum([len(f) // kind.itemsize for f in block["filters"]])])
    lists = np.frombuffer(b"".join(block["filters"]), kind).astype(np.int64)
    i, j = block["i"].iloc[0], block["j"].iloc[0]
    cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
    found = []
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        left, right = lo + np.flatnonzero(chunk[lo:hi] == i), lo + np.flatnonzero(chunk[lo:hi] == j)
        cosine = (x[left] @ x[right].T) / norm[left][:, None] / norm[right][None, :]
        near = cosine >= LEAST
        a, b = np.nonzero(np.triu(near, 1) if i == j else near)
        if not len(a):
            continue
        a, b = left[a] - lo, right[b] - lo
        row = np.repeat(np.arange(hi - lo), np.diff(starts[lo : hi + 1]))
        first = _first_common(row, lists[starts[lo] : starts[hi]], hi - lo, a, b, int(own[lo]))
        a, b = a[first], b[first]
        weight = copies[lo:hi].astype(float)
        more = np.bincount(a, weight[b], hi - lo) + np.bincount(b, weight[a], hi - lo)
        on = np.flatnonzero(more)
        low = _reached(hi - lo, a, b)
        found.append(np.stack([node[lo + on], more[on].astype(np.int64), node[lo + low[on]]]))
    return pd.DataFrame(np.concatenate(found, 1).T if found else np.zeros((0, 3), np.int64), columns=["node", "more", "low"])


def links(nodes: DataFrame) -> DataFrame:
    """(node, more, low) of the members of all blocks, see ``_within``."""
    rows = _filtered(_sized(nodes))
    group = ["label", "dim", "filter"]
    sizes = rows.groupBy(*group).agg(F.count("*").alias("size")).where("size > 1")
    chunked = rows.join(sizes, group).withColumn("chunks", F.ceil(F.col("size") / CHUNK).cast("int"))
    chunked = chunked.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    columns = [*group, "words", "node", "copies", "data", "filters", "chunk"]
    blocks = chunked.select(*columns, F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    blocks = blocks.select(*columns, F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    return blocks.groupBy("label", "dim", F.floor(F.col("filter") / TOGETHER).alias("few"), "i", "j").applyInPandas(_within, "node long, more long, low long")


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector."""
    prepared = checkpointed(_prepared(vectors))
    usable = prepared.where(F.col("data").isNotNull())
    nodes = usable.groupBy("label", "dim", "key").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("copies"), F.any_value("data").alias("data"))
    # A number by partition and place: unique, and fixed by the checkpoint.
    nodes = checkpointed(nodes.withColumn("node", F.monotonically_increasing_id()))
    found = checkpointed(links(nodes).groupBy("node", "low").agg(F.sum("more").alias("more")))
    counted = found.groupBy("node").agg(F.sum("more").alias("more"))
    joined = components(found.where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")))
    grouped = nodes.select("label", "dim", "key", "node", "least_id", "copies").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = grouped.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = grouped.join(names, "component").join(counted, "node", "left").select("label", "dim", "key", (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), "component_id")
    out = prepared.select("vec_id", "label", "dim", "key").join(named, ["label", "dim", "key"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.select("*", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
