"""SentencePiece models through the tokenizers library.

The model's protobuf is parsed here (no generated classes); from it come the normaliser, the
metaspace marker, the pieces' scores and the byte fallback, as a pipeline of the tokenizers
library that encodes batches on several threads. Unigram models keep their scores; in BPE models
the merges are recovered from the scores: each piece made of two other pieces, best score first.

Where no piece has a marker behind another character, a text can be cut before each run of
markers without changing the result, and parts that were met before aren't encoded again; else it is
encoded whole.

Defined cases: a null or empty text has no ids; null and repeated ids are kept, each row is
encoded by itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, text_of

MARK = "▁"
#: Parts of texts that a worker remembers (some 250 bytes each).
MEMO_PARTS = 1 << 19
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protobuf message: integers, or bytes of the other wire types."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 0x7F) << shift
            if b < 0x80:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        wire = key & 7
        if wire == 0:
            yield key >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(wire)
        if n is None:
            if wire != 2:
                raise ValueError(f"unexpected wire type {wire}")
            n = varint()
        yield key >> 3, data[at : at + n]
        at += n


@dataclass
class Model:
    """What a model file says. Field numbers are those of the public sentencepiece_model.proto."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = 1
    byte_fallback: bool = False
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True

    @classmethod
    def parse(cls, data: bytes) -> Model:
        out = cls()
        for number, value in _fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for k, v in _fields(value):
                    if k == 1:
                        piece = v.decode()
                    elif k == 2:
                        score = struct.unpack("<f", v)[0]
                    elif k == 3:
                        kind = v
                out.pieces.append((piece, score, kind))
            elif number == 2:
                for k, v in _fields(value):
                    if k == 3:
                        out.model_type = v
                    elif k == 35:
                        out.byte_fallback = bool(v)
            elif number == 3:
                for k, v in _fields(value):
                    if k == 2:
                        out.charsmap = v
                    elif k in (3, 4, 5):
                        setattr(out, ("add_dummy_prefix", "remove_extra_whitespaces", "escape_whitespaces")[k - 3], bool(v))
        return out

    @property
    def unk_id(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    def merges(self) -> list[tuple[str, str]]:
        """Pairs of pieces that join to a piece, best score first."""
        own = {p: s for p, s, kind in self.pieces if kind in (NORMAL, USER_DEFINED)}
        found = []
        for rank, (piece, score) in enumerate(own.items()):
            found += [(-score, rank, k, piece[:k], piece[k:]) for k in range(1, len(piece)) if piece[:k] in own and piece[k:] in own]
        return [x[3:] for x in sorted(found)]

    def splits(self) -> bool:
        """Whether a text may be cut before each run of markers."""
        return self.escape_whitespaces and not any(MARK in p.lstrip(MARK) for p, _, kind in self.pieces if kind in (NORMAL, USER_DEFINED))


def backend(model: Model):
    """The model as a Tokenizer of the tokenizers library."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if model.model_type == 2:
        vocab = {p: i for i, (p, _, _) in reversed(list(enumerate(model.pieces)))}
        core = models.BPE(vocab, model.merges(), unk_token=model.pieces[model.unk_id][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    elif model.model_type == 1:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=model.unk_id, byte_fallback=model.byte_fallback)
    else:
        raise ValueError("only unigram and BPE models are supported")
    out = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra_whitespaces:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip(left=True, right=True)]
    if model.add_dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    if model.escape_whitespaces:
        steps.append(normalizers.Replace(" ", MARK))
    out.normalizer = normalizers.Sequence(steps)
    if model.splits():
        out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    own = [AddedToken(p, normalized=False) for p, _, kind in model.pieces if kind == USER_DEFINED]
    if own:
        out.add_tokens(own)
    strip = [decoders.Strip(" ", left=1, right=0)] if model.add_dummy_prefix else []
    out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *strip])
    return out


def load(path: str):
    with open(path, "rb") as f:
        return backend(Model.parse(f.read()))


def _threads(threads: int) -> None:
    os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
    os.environ["RAYON_NUM_THREADS"] = os.environ["RAYON_RS_NUM_THREADS"] = str(threads)


class Codec:
    """Encodes batches through the library; parts of texts that it met before are remembered.

    Where texts may be cut before single blanks, the distinct new parts of a batch are encoded
    together, on several threads, and decoded again to see whether they come back; other texts are
    encoded whole. The first ``MEMO_PARTS`` parts stay in memory, as ids alone: the few that don't come
    back are in ``lost``.
    """

    def __init__(self, path: str, threads: int) -> None:
        _threads(threads)
        with open(path, "rb") as f:
            model = Model.parse(f.read())
        self.tokenizer = backend(model)
        self.threads = threads
        self.cuts = model.splits() and model.add_dummy_prefix and not model.charsmap and not model.remove_extra_whitespaces
        self.starts = np.array([p.startswith(MARK) for p, _, _ in model.pieces])
        self.memo: dict[str, bytes] = {}
        self.lost: set[str] = set()

    def parts(self, text: str) -> list[str]:
        """The text cut at its blanks, or whole where that isn't the same."""
        if not self.cuts or not text or text[0] == " " or text[-1] == " " or "  " in text or MARK in text:
            return [text]
        return text.split(" ")

    def new_parts(self, parts: list[str]) -> list[tuple[bytes, bool]]:
        """Parts are encoded some hundred at a time as one text: each starts with a marker, and only there is one."""
        lumps = [parts[k : k + 256] for k in range(0, len(parts), 256)]
        out = []
        for lump, (data, ok) in zip(lumps, self.new([" ".join(x) for x in lumps])):
            at = 4 * np.flatnonzero(self.starts[np.frombuffer(data, "<u4")])
            if not ok or len(at) != len(lump):
                out += self.new(lump)
            else:
                out += [(data[a:b], True) for a, b in zip(at.tolist(), [*at[1:].tolist(), len(data)])]
        return out

    def new(self, texts: list[str]) -> list[tuple[bytes, bool]]:
        ids = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        back = self.tokenizer.decode_batch(ids, skip_special_tokens=False)
        return [(array("I", x).tobytes(), a == b) for x, a, b in zip(ids, texts, back, strict=True)]

    def encode(self, texts: list[str]) -> list[tuple[bytes, bool]]:
        """(ids as little-endian unsigned 32-bit integers, whether decoding gives the text) of each text."""
        cut = [self.parts(x) for x in texts]
        known = [list(map(self.memo.get, parts)) for parts in cut]
        gaps = [[k for k, x in enumerate(ids) if x is None] for ids in known]
        held: dict[str, tuple[bytes, bool]] = {}
        whole = [parts[0] for parts, at in zip(cut, gaps) if at and len(parts) == 1]
        held |= zip(whole, self.new(whole))
        unknown = [p for p in dict.fromkeys(parts[k] for parts, at in zip(cut, gaps) for k in at) if p not in held]
        held |= zip(unknown, self.new_parts(unknown))
        out = []
        for parts, ids, at in zip(cut, known, gaps):
            ok = not self.lost or self.lost.isdisjoint(parts)
            for k in at:
                ids[k], back = held[parts[k]]
                ok = ok and back
            out.append((b"".join(ids), ok))
        for p, (ids, ok) in held.items():
            if len(self.memo) >= MEMO_PARTS:
                break
            if len(p) < 64:
                self.memo[p] = ids
                if not ok:
                    self.lost.add(p)
        return out

    def hold(self, other, texts: list[str], found: list[tuple[bytes, bool]]) -> None:
        """What ``encode`` gave for the texts, against the sentencepiece library: ids and, decoded as a whole, the text.

        The ids are the same on both sides, so the library decodes its own list of them. Where it reads them otherwise
        than the parts were read (it has signs of its own for unknown pieces), the tokenizers backend has the last word.
        """
        ids = other.encode(texts, num_threads=self.threads)
        if [array("I", x).tobytes() for x in ids] != [x for x, _ in found]:
            raise ValueError("the tokenizers backend and the sentencepiece library differ")
        back = other.decode(ids, num_threads=self.threads)
        doubt = [k for k, x in enumerate(back) if (x == texts[k]) != found[k][1]]
        back = self.tokenizer.decode_batch([ids[k] for k in doubt], skip_special_tokens=False) if doubt else []
        if any((x == texts[k]) != found[k][1] for k, x in zip(doubt, back)):
            raise ValueError("a text's ids decode otherwise than its parts")


@cache
def codec(path: str, threads: int) -> Codec:
    """One per worker process and model."""
    return Codec(path, threads)


def encode(docs: DataFrame, model: str, threads: int = 2, verify: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's ids: (doc_id, ids binary of little-endian uint32, n_tokens, round_trip).

    ``round_trip``: decoding gives the text again. ``model`` is a path that every executor has.
    ``verify``: of one text in so many (by its hash; 1: every text) the ids are held against the sentencepiece
    library's, which also decodes them as a whole; a difference is an error.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model, threads)
        if verify:
            import sentencepiece

            other = sentencepiece.SentencePieceProcessor(model_file=model)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = own.encode(texts)
            if verify:
                picked = [k for k, x in enumerate(texts) if crc32(x.encode("utf-8", "surrogatepass")) % verify == 0]
                own.hold(other, [texts[k] for k in picked], [found[k] for k in picked])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.binary()), pa.array([len(x) // 4 for x, _ in found], pa.int64()), pa.array([ok for _, ok in found], pa.bool_())], ["doc_id", "ids", "n_tokens", "round_trip"])

    return rows.mapInArrow(run, f"doc_id {kind}, ids binary, n_tokens long, round_trip boolean")


def decode(encoded: DataFrame, model: str, threads: int = 2) -> DataFrame:
    """(doc_id, text) of rows with ``doc_id`` and ``ids``; null ids give an empty text."""
    bound_batches(encoded.sparkSession)
    rows = encoded.select("doc_id", "ids")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _threads(threads)
        tokenizer = load(model)
        for batch in batches:
            ids = [np.frombuffer(x or b"", "<u4").tolist() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokenizer.decode_batch(ids, skip_special_tokens=False), pa.string())], ["doc_id", "text"])

    return rows.mapInArrow(run, f"doc_id {kind}, text string")
