"""Near-duplicate documents by DartMinHash.

A document is the weighted set of its shingles of five lower-case words; a shingle that occurs c
times covers the regions [0, 1), ..., [c - 1, c) of its weight axis. Hashed darts arrive at each
region as a Poisson process along the rank axis, the earliest first, and fall on a coordinate of the
signature; each coordinate keeps its earliest dart. Only darts up to a rank that fills all coordinates
are thrown (some k ln k of them, however long the text), further ones where a coordinate stays empty.
Equal coordinates are as likely as the weighted Jaccard similarity.

Documents are joined on bands of five coordinates: of pairs at 0.8, 3 in a million share none of the
32 bands. Candidates are checked exactly, on the texts. So that a group isn't compared pair by pair:

* equal word sequences are one node;
* each bucket is first compared with its smallest member only, and what links becomes one component;
* buckets that still hold several components are then compared across these, in blocks of two chunks of
  members: the largest component's against the others', and the others' among themselves;
* first by signatures alone: only members whose signature is near one of another component, in a bucket
  that is the first common one of the two, go on; these are compared again by their texts, and a block
  gives the links that join its components (a spanning forest).

So no link between components is left out, while a bucket costs a row per member and chunk of the other
side, and gives fewer links than it has members. A task holds two chunks of a bucket, however large it is.

Defined cases: a text without words (also null) is a class of its own; one with fewer words than a
shingle is one shingle; a null id is a class of its own (null); rows that repeat an id count as one
document; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, checkpointed, mix, released, runs_of, shingle_hashes, slices, text_of, utf8, word_hashes
from .components import components

BANDS, ROWS = 32, 5
COORDINATES = BANDS * ROWS
SHINGLE, LEAST = 5, 0.8
#: Signatures that agree in a smaller share can't (but for one pair in 300,000) reach ``LEAST``.
LEAST_ESTIMATE = 0.65
#: Members of a bucket that are compared at a time, by signatures and by texts.
CHUNK, TEXT_CHUNK = 2048, 512
#: Blocks of up to so many members are compared many at a time; pairs compared at a time; units kept for further pairs.
SMALL_BLOCK, PAIRS, HELD_UNITS = 64, 1 << 13, 1 << 22
_SCALE = 2.0**-53


def regions(shingles: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each unit of weight (shingle, how many equal ones come before), and its text."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((shingles, text))
    s, d = shingles[order], text[order]
    fresh = np.ones(len(s), bool)
    fresh[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    at = np.arange(len(s))
    before = at - np.maximum.accumulate(np.where(fresh, at, 0))
    return mix(s + before.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)), d


def _throw(units: np.ndarray, text: np.ndarray, limit: np.ndarray, n_texts: int) -> np.ndarray:
    """Signatures from the darts whose rank is below a text's limit; 0 marks an empty coordinate."""
    out = np.zeros(n_texts * COORDINATES, np.uint64)
    ranks, cells, ids = [], [], []
    rank, k = np.zeros(len(units)), 0
    while len(units):
        h = mix(units + np.uint64((k * 0x9E3779B97F4A7C15 + 1) & (2**64 - 1)))
        rank = rank - np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) * _SCALE)
        on = rank < limit[text]
        units, text, rank = units[on], text[on], rank[on]
        dart = mix(h[on] ^ np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
        ranks.append(rank)
        cells.append(text * COORDINATES + ((dart >> np.uint64(33)) % np.uint64(COORDINATES)).astype(np.int64))
        ids.append(dart)
        k += 1
    if ranks:
        all_ranks = np.concatenate(ranks)
        latest_first = np.argsort(-all_ranks, kind="stable")
        out[np.concatenate(cells)[latest_first]] = np.concatenate(ids)[latest_first]
    return out.reshape(n_texts, COORDINATES)


def signatures(units: np.ndarray, text: np.ndarray, n_texts: int) -> np.ndarray:
    """The dart that each coordinate of each text keeps; a text without units has zeros."""
    size = np.bincount(text, minlength=n_texts)
    limit = (COORDINATES * np.log(COORDINATES) + 2 * COORDINATES) / np.maximum(size, 1)
    out = _throw(units, text, limit, n_texts)
    while (empty := (out == 0).any(1) & (size > 0)).any():
        limit = np.where(empty, 2 * limit, 0.0)
        again = empty[text]
        new = _throw(units[again], text[again], limit, n_texts)
        out[empty] = new[empty]
        limit = np.where(empty, limit, 0.0)
    return out


def _sketch_slice(texts: list) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    data, offsets = utf8(texts)
    words, word_bounds = word_hashes(data, offsets)
    shingles, bounds = shingle_hashes(words, word_bounds, SHINGLE)
    units, text = regions(shingles, bounds)
    keys = [hashlib.blake2b(words[a:b].tobytes(), digest_size=16).digest() for a, b in zip(word_bounds[:-1], word_bounds[1:])]
    return signatures(units, text, len(texts)), np.diff(bounds), keys


def sketch_texts(texts: list) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Signatures, sizes in units, and a 128-bit key of the word sequence, of a batch of texts, slice by slice."""
    parts = [_sketch_slice(texts[a:b]) for a, b in slices(texts)] or [_sketch_slice([])]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), [k for p in parts for k in p[2]]


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, n, short, bands): ``short`` has 16 bits of each coordinate, ``bands`` a hash of each band."""
    bound_batches(docs.sparkSession, 1024)
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = np.arange(BANDS, dtype=np.uint64)
        for batch in released(batches):
            sig, n, keys = sketch_texts(batch.column(1).to_pylist())
            bands = np.tile(salt, (len(sig), 1))
            for k in range(ROWS):
                bands = mix(bands * np.uint64(0x2545F4914F6CDD1D) + sig.reshape(-1, BANDS, ROWS)[:, :, k])
            short = (sig >> np.uint64(8)).astype("<u2")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(n, pa.int64()), pa.array([x.tobytes() for x in short], pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * (len(sig) + 1), BANDS), pa.int32()), pa.array(bands.view(np.int64).ravel()))], ["doc_id", "key", "n", "short", "bands"])

    return rows.mapInArrow(run, "doc_id long, key binary, n long, short binary, bands array<long>")


def _units(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """The units of all texts, sorted within each, and where each text's begin."""
    data, offsets = utf8(texts)
    shingles, bounds = shingle_hashes(*word_hashes(data, offsets), SHINGLE)
    return regions(shingles, bounds)[0], bounds


def _similarity(x: np.ndarray, y: np.ndarray) -> float:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 0.0


def jaccard(texts_a: list, texts_b: list) -> list[float]:
    """Weighted Jaccard similarity of the shingles of texts, pair by pair."""
    out = []
    for a, b in slices([(x or "") + (y or "") for x, y in zip(texts_a, texts_b)]):
        (u, at), (v, to) = _units(texts_a[a:b]), _units(texts_b[a:b])
        out += [_similarity(u[at[i] : at[i + 1]], v[to[i] : to[i + 1]]) for i in range(b - a)]
    return out


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, similarity) of pairs, from their texts."""
    bound_batches(pairs.sparkSession, 64)
    side = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            s = jaccard(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64())], ["a", "b", "similarity"])

    return both.mapInArrow(run, "a long, b long, similarity double")


_BLOCK = ["bucket", "across", "i", "j"]


def _near(block: pa.Table, cuts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of the same block (rows between two cuts) that are on different sides, in different
    components, may be similar by their signatures, and share no earlier band."""
    sig = np.frombuffer(b"".join(block["short"].to_pylist()), "<u2").reshape(-1, COORDINATES)
    component, n, band, i, j, across, chunk, main = (block[c].to_numpy() for c in ("component", "n", "band", "i", "j", "across", "chunk", "main"))

    def near(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        apart = np.where(across[x] == 1, main[x] != main[y], (i[x] == j[x]) | (chunk[x] != chunk[y]))
        on = np.flatnonzero(apart & (component[x] != component[y]) & (n[y] >= LEAST * n[x]) & (n[x] >= LEAST * n[y]))
        x, y = x[on], y[on]
        for k in range(0, len(x), PAIRS):
            a, b = x[k : k + PAIRS], y[k : k + PAIRS]
            equal = sig[a] == sig[b]
            alike = equal.mean(1) >= LEAST_ESTIMATE
            a, b = a[alike], b[alike]
            first = equal[alike].reshape(-1, BANDS, ROWS).all(2).argmax(1) == band[a]
            yield a[first], b[first]

    sizes = np.diff(cuts)
    for size in np.unique(sizes[sizes > 1]).tolist():
        starts = cuts[:-1][sizes == size]
        if size <= SMALL_BLOCK:
            x, y = np.triu_indices(size, 1)
            many = max(1, 8 * PAIRS // len(x))
            for k in range(0, len(starts), many):
                at = starts[k : k + many, None]
                yield from near((at + x).ravel(), (at + y).ravel())
        else:
            for start in starts.tolist():
                for x in range(start, start + size - 1):
                    yield from near(np.full(start + size - 1 - x, x), np.arange(x + 1, start + size))


def _wanted(block: pa.Table, cuts: np.ndarray) -> pa.Table:
    """The members of blocks that have to be compared by their texts."""
    on = np.zeros(len(block), bool)
    for x, y in _near(block, cuts):
        on[x] = on[y] = True
    return block.select(["bucket", "band", "node", "n", "component"]).filter(pa.array(on))


def _compare(block: pa.Table, cuts: np.ndarray) -> pa.Table:
    """Links between the components of blocks: as many as join them, not all."""
    node, component, text = block["node"].to_numpy(), block["component"].to_numpy(), block["text"]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    units: dict[int, np.ndarray] = {}
    held = 0
    out = []
    for left, right in _near(block, cuts):
        for x, z in zip(left.tolist(), right.tolist()):
            a, b = root(int(component[x])), root(int(component[z]))
            if a == b:
                continue
            for k in (x, z):
                if int(node[k]) not in units:
                    if held > HELD_UNITS:
                        units, held = {key: units[key] for key in (int(node[x]), int(node[z])) if key in units}, 0
                    own = units[int(node[k])] = _units([text[k].as_py()])[0]
                    held += len(own)
            if _similarity(units[int(node[x])], units[int(node[z])]) >= LEAST:
                parent[a] = b
                out.append((node[x], node[z], component[x], component[z]))
    return pa.table({c: pa.array([r[k] for r in out], pa.int64()) for k, c in enumerate(("a", "b", "ca", "cb"))})


def _by_block(rows: DataFrame, run, schema: str) -> DataFrame:
    """``run(rows, cuts)`` of whole blocks, many small ones at a time."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, cuts in runs_of(released(batches), _BLOCK):
            yield from run(block, cuts).to_batches()

    return rows.repartition(*_BLOCK).sortWithinPartitions(*_BLOCK).mapInArrow(each, schema)


def _blocked(members: DataFrame, carried: DataFrame, chunk: int) -> DataFrame:
    """Members (bucket, band, node, n, component) of buckets with several components, with the columns ``carried``
    has by node, once for each block that they are in: ``across`` blocks have a chunk of the bucket's largest
    component and one of the others, the rest two chunks of the others."""
    sizes = members.groupBy("bucket", "component").agg(F.count("*").alias("size"))
    mixed = sizes.groupBy("bucket").agg(F.max(F.struct("size", "component")).alias("top"), F.sum("size").alias("all"), F.count("*").alias("several")).where("several > 1")
    # apart from the join, so that Spark may split that where a bucket is large
    mixed = checkpointed(mixed.select("bucket", F.col("top.component").alias("top"), F.col("top.size").alias("most"), "all", "several"))
    chunks = lambda c: F.ceil(c / chunk).cast("int")
    mixed = mixed.select("bucket", "top", "several", chunks(F.col("most")).alias("mains"), chunks(F.col("all") - F.col("most")).alias("others"))
    rows = members.join(mixed, "bucket").withColumn("main", F.col("component") == F.col("top"))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("node"), F.when(F.col("main"), F.col("mains")).otherwise(F.col("others"))).cast("int"))
    count = lambda n: F.transform(F.sequence(F.lit(0), n - 1), lambda k: k)
    block = lambda across, i, j: F.struct(F.lit(across).alias("across"), i.alias("i"), j.alias("j"))
    own = F.col("chunk")
    of_main = F.transform(count(F.col("others")), lambda k: block(1, own, k))
    of_other = F.transform(count(F.col("mains")), lambda k: block(1, k, own))
    among = F.when(F.col("several") > 2, F.transform(count(F.col("others")), lambda k: block(0, F.least(own, k), F.greatest(own, k)))).otherwise(F.array().cast("array<struct<across:int,i:int,j:int>>"))
    places = F.when(F.col("main"), of_main).otherwise(F.concat(of_other, among))
    return rows.select("bucket", "band", "node", "n", "component", "main", "chunk", F.inline(places)).join(carried, "node")


def _across(members: DataFrame, found: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b, ca, cb) between components that share a bucket."""
    named = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    bound_batches(members.sparkSession, 256)
    near = _by_block(_blocked(named, nodes.select("node", "short"), CHUNK), _wanted, "bucket long, band int, node long, n long, component long")
    near = checkpointed(near.distinct())
    own = near.select("node").distinct().join(texts.select(F.col("doc_id").alias("node"), "text"), "node").join(nodes.select("node", "short"), "node")
    return _by_block(_blocked(near, own, TEXT_CHUNK), _compare, "a long, b long, ca long, cb long")


def _links(members: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, component) of all nodes that are similar to another one."""
    first = members.where("node > low").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct()
    found = checkpointed(components(_verified(first, texts).where(F.col("similarity") >= LEAST).select("a", "b")))
    edges = checkpointed(_across(members, found, nodes, texts))
    if edges.isEmpty():
        return found
    top = checkpointed(components(edges.select(F.col("ca").alias("a"), F.col("cb").alias("b"))))
    ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("ca").alias("component")), F.struct(F.col("b").alias("node"), F.col("cb").alias("component")))).alias("x")
    every = found.unionByName(edges.select(ends).select("x.*")).distinct()
    moved = top.select(F.col("node").alias("component"), F.col("component").alias("now"))
    return every.join(moved, "component", "left").select("node", F.coalesce("now", "component").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, kept) of every document: the smallest id of its class, and whether it is that."""
    sketched = checkpointed(sketch(docs, id_col, text_col))
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    nodes = checkpointed(sketched.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("node"), F.any_value("n").alias("n"), F.any_value("short").alias("short"), F.any_value("bands").alias("bands")))
    members = nodes.select("node", "n", F.posexplode("bands").alias("band", "bucket"))
    buckets = members.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("bucket", "low")
    members = checkpointed(members.join(buckets, "bucket"))
    found = _links(members, nodes, texts)
    classes = nodes.select("key", "node").join(found, "node", "left").select("key", F.coalesce("component", "node").alias("class_id"))
    out = sketched.select("doc_id", F.when(F.col("n") > 0, F.col("key")).alias("key")).join(classes, "key", "left")
    out = out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    unnamed = docs.where(F.col(id_col).isNull()).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"))
    return out.unionByName(unnamed).select("*", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents whose id names their class; rows with a null id stay."""
    gone = near_duplicates(docs, id_col, text_col).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col(id_col) == F.col("__gone"), "left_anti")
