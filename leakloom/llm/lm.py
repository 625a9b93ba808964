"""Language-model scoring by a weighted backoff automaton.

The model has n-grams of up to ``ORDER`` tokens with Dirichlet smoothing (MacKay and Peto): with p(w) the
unigram estimate, p(w | h) = (c(h w) + m p(w | h')) / (c(h) + m), where h' is h without its first token
and m the strength of h's length; it sums to one for every h. As an automaton: a state per seen history,
an arc per seen n-gram from its history, weighted by that probability and leading to the longest seen
history behind it, and a failure arc of weight m / (c(h) + m) to the state of h'. The root's arcs are all
unigrams. A text is read once from left to right: a state that has no arc for the token is left by
failure arcs until one has, and all weights on the way add up. Long texts are read as lanes side by side;
a lane inside a text first reads the ``ORDER - 1`` tokens before it, which fix its state.

No task and no broadcast holds the model, which grows with the corpus. Texts form blocks of some
megabytes. A block asks for the n-grams that it has, as keys cut at fixed key ranges; the task of a range
adds up the training counts of all blocks and answers each block with the counts of its keys, in its
order. So a block gets the slice of the automaton that its texts can reach, and its size is bounded by
the block. A frequent n-gram costs one key per block, not one per occurrence. Ranges and partitions grow
in number with the corpus, not in size; ranges are dealt to partitions in turn, so that none gets more than
its share; a block has no row for a range that it has no key in.
Unigrams are told apart by 64 bits, longer n-grams by their range and 40 bits more: of a million
distinct ones within a range, one in a million shares its count with another.

The input is read twice and must give the same rows in the same order, as a table scan does; a block
whose answers don't fit its texts fails. The answers are a Parquet table in the shared folder.

Defined cases: a null or empty text has only the end token; a null id is in the training part
(remainder 0); repeated rows count each time; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, mix, shared_path, text_of, utf8, word_hashes

#: Tokens of the longest n-grams, and the strength of the shorter history's estimate, in tokens, by n-gram length.
ORDER = 3
STRENGTH = {2: 100.0, 3: 4.0}
#: Bytes of text in a block, of text that a range of keys stands for, and of text for a partition of ranges or blocks.
BLOCK_BYTES, RANGE_BYTES, PART_BYTES = 6 << 20, 2 << 20, 8 << 20
#: From this many ranges on they get larger instead, up to ``LARGE_RANGE`` bytes of text, and from
#: ``MANY_BLOCKS`` on blocks do, up to ``LARGE_BLOCK``: so a block's rows for a range stay worth their overhead.
MANY_RANGES, LARGE_RANGE = 4096, 256 << 20
MANY_BLOCKS, LARGE_BLOCK = 170_000, 64 << 20
MANY_PARTS = 20_000
#: Bytes that tell the n-grams of a range apart.
KEY_BYTES = {1: 8, 2: 5, 3: 5}
LANE = 256
END, START = np.uint64(0x5EED_0000_0000_0001), np.uint64(0x5EED_0000_0000_0002)
_ROOT, _BEGIN, _FIRST = 0, 1, 2
_ASKED = "block long, range int, order int, keys binary, counts binary"
_ANSWERED = "block long, range int, order int, counts binary, large binary, total long, types long"


@dataclass
class Grams:
    """The n-grams of a block of texts. A text is a start mark and its tokens, the end token last.

    ``keys[k]`` has the distinct n-grams of ``k`` tokens in order, ``index[k]`` the place of the one that
    ends at each slot (a slot is a token or a start mark; meaningless where there is none), ``first[k]``
    a slot that each one ends at, ``at`` each slot's place in its text.
    """

    keys: dict[int, np.ndarray]
    index: dict[int, np.ndarray]
    first: dict[int, np.ndarray]
    at: np.ndarray
    text: np.ndarray
    end: int

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> Grams:
        words, cuts = word_hashes(data, offsets)
        n = len(offsets) - 1
        bounds = cuts + 2 * np.arange(n + 1)
        text = np.repeat(np.arange(n), np.diff(bounds))
        at = np.arange(bounds[-1]) - bounds[:-1][text]
        symbol = np.empty(bounds[-1], np.uint64)
        inner = np.ones(len(symbol), bool)
        inner[bounds[:-1]] = inner[bounds[1:] - 1] = False
        symbol[inner], symbol[bounds[:-1]], symbol[bounds[1:] - 1] = words, START, END
        keys, index, first, key = {}, {}, {}, symbol
        for k in range(1, order + 1):
            if k > 1:
                before = np.concatenate([key[:1], key[:-1]])
                key = mix(before * np.uint64(0x9E3779B97F4A7C15) + symbol + np.uint64(k))
            slots = np.flatnonzero(at >= max(1, k - 1))
            keys[k], own, inverse = np.unique(key[slots], return_index=True, return_inverse=True)
            first[k] = slots[own]
            index[k] = np.zeros(len(symbol), np.int64)
            index[k][slots] = inverse
        return cls(keys, index, first, at, text, int(np.searchsorted(keys[1], END)))

    def counts(self, learns: np.ndarray, k: int) -> np.ndarray:
        """How often each n-gram of ``k`` tokens ends at a slot of the texts that ``learns`` marks."""
        slots = (self.at >= max(1, k - 1)) & learns[self.text]
        return np.bincount(self.index[k][slots], minlength=len(self.keys[k]))


@dataclass
class Automaton:
    """The part of the backoff automaton that a block can reach; weights are logarithms to base 10.

    State 0 is the root, 1 the start of a text, then come the n-grams by length. ``arc`` holds state and
    word of each arc in one number, sorted.
    """

    root_weight: np.ndarray
    root_to: np.ndarray
    arc: np.ndarray
    arc_weight: np.ndarray
    arc_to: np.ndarray
    failure_weight: np.ndarray
    failure_to: np.ndarray

    @classmethod
    def build(cls, grams: Grams, counts: dict[int, np.ndarray], total: int, types: int) -> Automaton:
        order = max(grams.keys)
        base = {k: _FIRST + sum(len(grams.keys[j]) for j in range(1, k)) for k in range(1, order + 1)}
        p = {1: (counts[1] + 0.5) / (total + 0.5 * (types + 1))}
        texts = counts[1][grams.end] if len(counts[1]) else 0
        n_states = base[order]
        failure_weight, failure_to = np.zeros(n_states), np.zeros(n_states, np.int64)
        failure = lambda c, k: np.log10(STRENGTH[k] / (c + STRENGTH[k]))
        if order > 1:
            failure_weight[_BEGIN] = failure(texts, 2)
        arcs = []
        for k in range(1, order + 1):
            slot = grams.first[k]
            shorter = base[k - 1] + grams.index[k - 1][slot] if k > 1 else np.full(len(slot), _ROOT)
            own = base[k] + np.arange(len(slot))
            if k < order:
                failure_weight[own], failure_to[own] = failure(counts[k], k + 1), shorter
            if k == 1:
                continue
            before = slot - 1
            begins = grams.at[before] == 0
            history = np.where(begins, _BEGIN, base[k - 1] + grams.index[k - 1][before])
            seen_before = np.where(begins, texts, counts[k - 1][grams.index[k - 1][before]])
            p[k] = (counts[k] + STRENGTH[k] * p[k - 1][grams.index[k - 1][slot]]) / (seen_before + STRENGTH[k])
            on = counts[k] > 0
            arcs.append((history[on] << 32 | grams.index[1][slot[on]], np.log10(p[k][on]), (own if k < order else shorter)[on]))
        arc, weight, to = (np.concatenate(x) for x in zip(*arcs)) if arcs else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        by = np.argsort(arc)
        root_to = np.where((counts[1] > 0) & (order > 1), base[1] + np.arange(len(counts[1])), _ROOT)
        return cls(np.log10(p[1]), root_to, arc[by], weight[by], to[by], failure_weight, failure_to)

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(weight, next state) of one token read in each state: failure arcs until a state has an arc for it."""
        state = state.copy()
        weight, to = np.zeros(len(state)), np.zeros(len(state), np.int64)
        here = np.arange(len(state))
        while len(here):
            s, w = state[here], word[here]
            root = s == _ROOT
            weight[here[root]] += self.root_weight[w[root]]
            to[here[root]] = self.root_to[w[root]]
            here, s, w = here[~root], s[~root], w[~root]
            if not len(here):
                break
            wanted = s << 32 | w
            at = np.minimum(np.searchsorted(self.arc, wanted), len(self.arc) - 1)
            own = self.arc[at] == wanted if len(self.arc) else np.zeros(len(here), bool)
            weight[here[own]] += self.arc_weight[at[own]]
            to[here[own]] = self.arc_to[at[own]]
            here, s = here[~own], s[~own]
            weight[here] += self.failure_weight[s]
            state[here] = self.failure_to[s]
        return weight, to

    def read(self, word: np.ndarray, bounds: np.ndarray, order: int = ORDER, lane: int = LANE) -> np.ndarray:
        """Log-probability of each text, of the words ``bounds[i]:bounds[i + 1]``."""
        if len(bounds) < 2:
            return np.zeros(0)
        size = np.diff(bounds)
        lanes = -(-size // lane)
        text = np.repeat(np.arange(len(size)), lanes)
        k = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = bounds[:-1][text] + k * lane
        length = np.minimum(lane, bounds[1:][text] - begin)
        by = np.argsort(-length, kind="stable")
        text, k, begin, length = text[by], k[by], begin[by], length[by]
        state = np.where(k == 0, _BEGIN if order > 1 else _ROOT, _ROOT)
        inside = np.flatnonzero(k > 0)
        for back in range(order - 1, 0, -1):
            state[inside] = self.step(state[inside], word[begin[inside] - back])[1]
        total = np.zeros(len(text))
        on = np.searchsorted(-length, -np.arange(length[0]), "left")  # lanes longer than each step
        for t, n in enumerate(on.tolist()):
            weight, state[:n] = self.step(state[:n], word[begin[:n] + t])
            total[:n] += weight
        return np.bincount(text, total, len(size))


def score_block(grams: Grams, counts: dict[int, np.ndarray], total: int, types: int) -> dict[str, np.ndarray]:
    """The scores of a block's texts, from the training counts of its n-grams."""
    if any(len(counts[k]) != len(grams.keys[k]) for k in grams.keys):
        raise ValueError("a block was read twice and differs; the input must be stable, as a table scan is")
    token = grams.at > 0
    word, text = grams.index[1][token], grams.text[token]
    n = int(grams.text[-1]) + 1 if len(grams.text) else 0
    size = np.bincount(text, minlength=n)
    automaton = Automaton.build(grams, counts, total, types)
    sums = lambda x: np.bincount(text, x[word], n)
    known = sums((counts[1] > 0).astype(float)).astype(np.int64)
    scores = automaton.read(word, np.concatenate([[0], np.cumsum(size)]), max(grams.keys))
    return {"n_tokens": size, "n_known": known, "train_tokens": np.full(n, total), "base_score": sums(automaton.root_weight), "score": scores}


def layout(size: int) -> tuple[int, int, int, int]:
    """(ranges, partitions of ranges, bytes of a block, partitions of blocks) for so many bytes of text."""
    ranges = max(16, min(MANY_RANGES, size // RANGE_BYTES), size // LARGE_RANGE)
    parts = max(1, min(MANY_PARTS, size // PART_BYTES))
    return ranges, max(4, min(parts, ranges // 4)), min(LARGE_BLOCK, max(BLOCK_BYTES, size // MANY_BLOCKS)), max(4, parts)


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[int, list, list, np.ndarray, np.ndarray]]:
    """(block, ids, held out, text bytes, offsets) of each block of a partition; its first row's number names it."""
    name, ids, held, texts, size = None, [], [], [], 0
    for batch in batches:
        for i, h, t, row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            name = row if name is None else name
            ids.append(i)
            held.append(h)
            texts.append(t)
            size += len(t)
            if size >= block_bytes:
                yield name, ids, held, *utf8(texts)
                name, ids, held, texts, size = None, [], [], [], 0
    if ids:
        yield name, ids, held, *utf8(texts)


def _slices(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """The byte strings between the places ``at`` of some bytes."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def _asked(block: int, grams: Grams, learns: np.ndarray, ranges: int) -> Iterator[pa.RecordBatch]:
    """A row for each range that the block has keys in; a count above 255 is a key more than once."""
    for k, keys in grams.keys.items():
        counts = grams.counts(learns, k)
        times = np.maximum(1, -(-counts // 255))
        last = np.cumsum(times) - 1
        own = np.repeat(keys, times)
        parts = np.full(len(own), 255)
        parts[last] = counts - 255 * (times - 1)
        where = ((own >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)
        cuts = np.concatenate([np.flatnonzero(np.diff(where, prepend=-1)), [len(own)]])
        label = where[cuts[:-1]]
        raw = np.ascontiguousarray(own.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : KEY_BYTES[k]])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(label), block)), pa.array(label), pa.array(np.full(len(label), k, np.int32)), _slices(raw, cuts * KEY_BYTES[k]), _slices(parts.astype(np.uint8), cuts)], ["block", "range", "order", "keys", "counts"])


def _answered(group: pd.DataFrame) -> pd.DataFrame:
    """For each block's keys of a range their counts in all blocks: a byte each, 255 where ``large`` goes on with 8 bytes."""
    out = []
    for k, part in group.groupby("order"):
        sizes = np.array([len(x) for x in part["counts"]])
        raw = np.zeros((sizes.sum(), 8), np.uint8)
        raw[:, : KEY_BYTES[k]] = np.frombuffer(b"".join(part["keys"]), np.uint8).reshape(-1, KEY_BYTES[k])
        keys, inverse = np.unique(raw.view("<u8").ravel(), return_inverse=True)
        sums = np.bincount(inverse, np.frombuffer(b"".join(part["counts"]), np.uint8), len(keys)).astype(np.int64)
        row = np.repeat(np.arange(len(part)), sizes)
        fresh = np.ones(len(row), bool)
        fresh[1:] = (inverse[1:] != inverse[:-1]) | (row[1:] != row[:-1])  # keys that came more than once are answered once
        found, row = sums[inverse[fresh]], row[fresh]
        small, big = np.minimum(found, 255).astype(np.uint8), found >= 255
        cuts = lambda x: np.searchsorted(x, np.arange(len(part) + 1))
        text = lambda data, at: [data[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        one = pd.DataFrame({"block": part["block"], "range": part["range"], "order": np.int32(k), "counts": text(small.tobytes(), cuts(row)), "large": text(found[big].astype("<u8").tobytes(), 8 * cuts(row[big]))})
        one["total"] = one["types"] = np.int64(0)
        if k == 1:
            one.iloc[0, -2:] = int(sums.sum()), int((sums > 0).sum())
        out.append(one)
    return pd.concat(out)


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every text.

    The model learns from the rows outside ``held_out``.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    size = docs.agg(F.sum(F.octet_length(text_of(text_col)))).first()[0] or 0
    ranges, range_parts, block_bytes, block_parts = layout(size)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), text_of(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, held, data, offsets in _blocks(batches, block_bytes):
            yield from _asked(block, Grams.of(data, offsets), ~np.asarray(held, bool), ranges)

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, held, data, offsets in _blocks(batches, block_bytes):
            one = pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())), pa.array([offsets.tolist()], pa.list_(pa.int64())), pa.array([data.tobytes()], pa.binary())], ["ids", "held", "offsets", "data"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, one.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_batch(one)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([-1], pa.int32()), pa.array([0], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([b""], pa.binary())], ["block", "range", "order", "counts", "large"])

    path = shared_path(spark, "lm")
    answers = rows.mapInArrow(asked, _ASKED).repartitionById(range_parts, "range").groupBy("range").applyInPandas(_answered, _ANSWERED)
    answers.write.option("parquet.enable.dictionary", "false").parquet(path)
    answers = spark.read.parquet(path)
    sums = answers.agg(F.sum("total"), F.sum("types")).first()
    total, types = (int(x or 0) for x in sums)

    def scored(group: pd.DataFrame) -> pd.DataFrame:
        texts = group[group["order"] == 0].iloc[0]
        one = pa.ipc.open_stream(texts["counts"]).read_all()
        grams = Grams.of(np.frombuffer(one["data"][0].as_py(), np.uint8), np.asarray(one["offsets"][0].as_py(), np.int64))
        counts = {}
        for k in grams.keys:
            part = group[group["order"] == k].sort_values("range")
            counts[k] = np.frombuffer(b"".join(part["counts"]), np.uint8).astype(np.int64)
            counts[k][counts[k] == 255] = np.frombuffer(b"".join(part["large"]), "<u8")
        found = score_block(grams, counts, total, types)
        return pd.DataFrame({"doc_id": pd.array(one["ids"][0].as_py(), "Int64"), "held_out": one["held"][0].as_py(), **found})

    texts = rows.mapInArrow(carried, "block long, range int, order int, counts binary, large binary")
    both = answers.drop("total", "types").unionByName(texts).repartition(block_parts, "block")
    return both.groupBy("block").applyInPandas(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
