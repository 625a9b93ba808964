"""Packing by power-of-two decomposition.

Every document is cut into pieces whose lengths are powers of two: as many full pieces of
``seq_len`` tokens as fit, then the binary digits of the rest, longest first. Each piece is a
sequence of its own, in the bucket of its length, so no sequence crosses documents and nothing is
padded. A training loop draws each batch from one bucket, with ``batch tokens / length`` rows.

Nothing is shuffled: a document's pieces depend on that document alone.

Defined cases: a null or empty text is one piece that holds the end token; null and repeated ids
are kept, each row is packed by itself; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, released, text_of

#: Distinct words and parts between blanks, in all, whose ids a worker remembers (some 140 bytes each):
#: the first ones it meets; further ones are encoded each time.
MEMO_WORDS = 3 << 18


class WordTokenizer:
    """Ids of a byte-level BPE tokenizers file, with the ids of words seen before remembered.

    The file's pre-tokenizer cuts a text into words that its model encodes independently; the
    public pattern of the file finds them. It always cuts before a blank that stands alone, so the
    parts between such blanks are remembered too, and the pattern only looks into new parts. A word that
    begins with a blank is the part behind that blank, so both are remembered once.
    A text that holds one of the file's special tokens is encoded whole by the library.
    """

    def __init__(self, path: str, pattern: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.find = regex.compile(pattern).findall
        self.wide = regex.compile(r" \s").search
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # The usual printable stand-ins of byte-level BPE: printable Latin-1 stays, the others follow from U+0100.
        stay = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        self.stand_in = dict(zip([b for b in range(256) if b not in stay], range(256, 512)))
        self.model = self.tokenizer.model
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, word: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.stand_in))]).tobytes()

    def by_word(self, text: str) -> bytes:
        out = []
        for w in self.find(text):
            memo, key = (self.parts, w[1:]) if w[0] == " " and " " not in w[1:] else (self.words, w)
            ids = memo.get(key)
            if ids is None:
                ids = self.word(w)
                self.remember(memo, key, ids)
            out.append(ids)
        return b"".join(out)

    def remember(self, memo: dict[str, bytes], key: str, ids: bytes) -> None:
        if len(self.words) + len(self.parts) < MEMO_WORDS and len(key) < 64:
            memo[key] = ids

    def __call__(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        if any(s in text for s in self.special):
            return self.whole(text)
        if self.wide(text):
            return self.by_word(text)
        first, *rest = text.split(" ")
        memo = self.parts
        found = list(map(memo.get, rest))
        i = -1
        for _ in range(found.count(None)):
            i = found.index(None, i + 1)
            ids = found[i] = self.by_word(" " + rest[i])
            self.remember(memo, rest[i], ids)
        return self.by_word(first) + b"".join(found)


@cache
def word_tokenizer(path: str, pattern: str) -> WordTokenizer:
    """One per worker process, so that the next task finds what an earlier one remembered."""
    return WordTokenizer(path, pattern)


def piece_lengths(n: int, seq_len: int) -> list[int]:
    """The lengths of a document of ``n`` tokens: full sequences, then the binary digits of the rest."""
    rest = n % seq_len
    return [seq_len] * (n // seq_len) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, tokenizer: str, pattern: str, seq_len: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents: id, start, length, ids (binary, little-endian uint32), doc_tokens, sequence_id, offset, bucket."""
    if seq_len < 1 or seq_len & (seq_len - 1):
        raise ValueError("seq_len must be a power of two")
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_tokenizer(tokenizer, pattern)
        for batch in released(batches):
            at, start, length, ids, total = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                data = encode(text) + end
                n = len(data) // 4
                begin = 0
                for k in piece_lengths(n, seq_len):
                    at.append(i)
                    start.append(begin)
                    length.append(k)
                    ids.append(data[4 * begin : 4 * (begin + k)])
                    total.append(n)
                    begin += k
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array(total, pa.int64())], ["doc_id", "start", "length", "ids", "doc_tokens"])

    pieces = rows.mapInArrow(run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long")
    return pieces.select("*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.log2("length").cast("int").alias("bucket"))


def unpack(pieces: DataFrame) -> DataFrame:
    """Documents' ids again, in order: (doc_id, ids); ids must be unique for this."""
    parts = F.array_sort(F.collect_list(F.struct("start", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["ids"]))
    return pieces.groupBy("doc_id").agg(joined.alias("ids"))
