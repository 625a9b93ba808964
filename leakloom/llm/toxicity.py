"""Toxic spans by a linear-chain conditional random field.

Training is on the driver, over a bounded sample of labelled documents: at most ``max_per_class``
of each class, those whose id has the smallest hash, and of these whole documents of ``max_bytes`` in all of each: one that
doesn't fit any more is skipped and the next is looked at. Words and word beginnings that a share of the
toxic documents has and (almost) no clean one label the tokens; the field (clean and toxic states,
transitions, one weight for each such feature) is fitted to windows of labelled tokens by gradient
ascent. Forward-backward marginals of a whole document give its offending spans, and their maximum
and sum, through a logistic curve, its score.

Tokens without a feature all have the same potentials, so a run of them is one matrix power; the
marginals at the others are exact, and a text costs one dictionary look-up per token.

Defined cases: null, empty and word-free texts get the score of a text without any feature; null
labels are skipped, of a document's labels the largest counts; without labels of both classes every
score is some 2e-9, and a warning says so where a class has labelled texts but none of ``max_bytes`` or less; null and repeated ids are kept, each row is scored by itself; an empty table gives no
rows; other columns (and labels, language, source and id) are never inputs of a score.
"""

from __future__ import annotations

import re
import warnings
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, checkpointed, released, text_of

_WORD = re.compile(r"[^\W_]+")
#: Labelled documents of each class that training takes at most.
MAX_PER_CLASS = 3000
#: Bytes of their texts, of each class.
MAX_BYTES = 32 << 20
PREFIXES = (4, 5, 6)
#: A feature is in this share of the sampled toxic documents, and in 5 at least, and this many times more often than in clean ones.
LEAST_SHARE, LEAST_DOCS, LEAST_RATIO = 0.01, 5, 25.0
WINDOW = 6
MEMO_WORDS = 1 << 18
PREDICT_AT = 0.3


def features(word: str) -> list[str]:
    """A lower-case word and its beginnings."""
    return ["=" + word, *(word[:k] for k in PREFIXES if len(word) > k)]


@dataclass
class Field:
    """The fitted field: log potentials relative to the clean state, and the logistic curve."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -8.0
    start: float = 0.0
    enter: float = 0.0
    stay: float = 0.0
    curve: tuple[float, float, float] = (-20.0, 0.0, 0.0)

    def emission(self, word: str) -> float:
        """Points of a word's features; 0 if it has none."""
        return sum(self.weights.get(f, 0.0) for f in features(word.lower()))

    def marginals(self, at: list[int], points: list[float], n: int) -> list[float]:
        """P(toxic) at the tokens ``at`` of ``n``; the tokens between them have no feature."""
        t = np.exp([[0.0, self.enter], [0.0, self.stay]])
        step = t * np.exp([0.0, self.bias])  # into a token without a feature
        values, vectors = np.linalg.eig(step)
        k = np.argmax(np.abs(values))
        values, back = np.real(values / values[k]), np.linalg.inv(vectors)
        power = lambda m: np.real(vectors * values**m @ back)
        first = np.exp([0.0, self.start])
        out, alphas, alpha, last = [], [], first, -1
        own = [np.array([1.0, np.exp(min(self.bias + p, 30.0))]) for p in points]
        for i, e in zip(at, own):
            if last < 0:
                alpha = first * e if i == 0 else (first * np.exp([0.0, self.bias])) @ power(i - 1) @ t * e
            else:
                alpha = alpha @ power(i - last - 1) @ t * e
            alpha = alpha / alpha.sum()
            alphas.append(alpha)
            last = i
        beta = power(n - 1 - at[-1]) @ np.ones(2) if at else None
        for j in range(len(at) - 1, -1, -1):
            beta = beta / beta.sum()
            p = alphas[j] * beta
            out.append(float(p[1] / p.sum()))
            if j:
                beta = power(at[j] - at[j - 1] - 1) @ (t @ (own[j] * beta))
        return out[::-1]

    def summary(self, marginals: list[float]) -> tuple[float, float]:
        top = min(max(max(marginals, default=0.0), 1e-6), 1 - 1e-6)
        return float(np.log(top / (1 - top))), float(np.log1p(sum(marginals)))

    def score(self, marginals: list[float]) -> float:
        a, b, c = self.curve
        z1, z2 = self.summary(marginals)
        return float(1 / (1 + np.exp(-np.clip(a + b * z1 + c * z2, -50, 50))))


class Scorer:
    """Scores texts with a field; remembers the points of words."""

    def __init__(self, fitted: Field) -> None:
        self.field, self.memo = fitted, {}
        self.none = fitted.score([])

    def hits(self, text: str) -> tuple[list[int], list[float], int]:
        words, memo = _WORD.findall(text), self.memo
        found = list(map(memo.get, words))
        at, points = [], []
        for i, p in enumerate(found):
            if p is None:
                p = self.field.emission(words[i])
                if len(memo) < MEMO_WORDS:
                    memo[words[i]] = p
            if p:
                at.append(i)
                points.append(p)
        return at, points, len(words)

    def marginals(self, text: str) -> tuple[list[int], list[float]]:
        at, points, n = self.hits(text)
        return at, self.field.marginals(at, points, n) if at else []

    def __call__(self, text: str) -> tuple[float, list[dict]]:
        """(score, spans of tokens that are likelier toxic than not, in code points)."""
        at, p = self.marginals(text)
        if not at:
            return self.none, []
        where = dict(zip(at, p))
        spans = [{"start": m.start(), "end": m.end(), "p": where[i]} for i, m in enumerate(_WORD.finditer(text)) if where.get(i, 0.0) > 0.5]
        return self.field.score(p), spans


def _counts(texts: list[str], least: float = 0.0, wanted: set[str] | None = None) -> dict[str, int]:
    """In how many texts each feature is, copies counted once.

    Near copies mostly share the run of three words with the smallest hash; texts that do are one
    group. Of three such groupings that with the fewest groups counts.
    """
    salts, known = (1, 2, 3), {}
    words, least_runs = [], []
    for text in texts:  # one text at a time: only its distinct words stay, each string once for all texts
        w = [known.setdefault(x, x) for x in _WORD.findall(text.lower())]
        runs = {" ".join(w[i : i + 3]).encode() for i in range(max(1, len(w) - 2))}
        words.append(tuple(set(w)))
        least_runs.append([min(crc32(x, salt) for x in runs) for salt in salts])
    out: dict[str, int] | None = None
    for k in range(len(salts)):
        groups: dict[int, set[str]] = {}
        for w, own in zip(words, least_runs):
            groups.setdefault(own[k], set()).update(w)
        found: Counter = Counter()
        for w in groups.values():
            own = {f for x in w for f in features(x)}
            found.update(own if wanted is None else own & wanted)
        out = {f: n if out is None else min(n, out[f]) for f, n in found.items() if n >= least and (out is None or f in out)}
        wanted = set(out)
    return out or {}


def lexicon(toxic: list[str], clean: list[str]) -> set[str]:
    """Features of toxic documents, from document counts."""
    in_toxic = _counts(toxic, max(LEAST_DOCS, LEAST_SHARE * len(toxic)))
    in_clean: Counter = Counter()
    for text in clean:
        in_clean.update({f for w in set(_WORD.findall(text.lower())) for f in features(w)} & in_toxic.keys())
    rate = lambda f: ((in_toxic[f] + 0.5) / (len(toxic) + 1)) / ((in_clean[f] + 0.5) / (len(clean) + 1))
    return {f for f in in_toxic if rate(f) >= LEAST_RATIO}


def _windows(texts: list[str], chosen: set[str], label: int) -> list[tuple[list[tuple[str, ...]], list[int]]]:
    """Windows of tokens, each a list of features and its label: around features, and one other per text."""
    out = []
    for text in texts:
        words = [tuple(f for f in features(w) if f in chosen) for w in _WORD.findall(text.lower())]
        at = [i for i, w in enumerate(words) if w]
        centres, last = [len(words) // 2], -WINDOW
        for i in at:
            if i - last >= WINDOW:
                centres.append(i)
                last = i
        for c in centres:
            part = words[max(0, c - WINDOW) : c + WINDOW + 1]
            if part:
                out.append((part, [int(bool(w) and label) for w in part]))
    return out


def fit(toxic: list[str], clean: list[str], shares: tuple[float, float] = (1.0, 1.0), steps: int = 150) -> Field:
    """The field and the curve for texts of both classes; ``shares``: rows that a text of each stands for."""
    if not toxic or not clean:
        return Field()
    chosen = lexicon(toxic, clean)
    index = {f: i for i, f in enumerate(sorted(chosen))}
    windows = _windows(toxic, chosen, 1) + _windows(clean, chosen, 0)
    length, count = 2 * WINDOW + 1, len(windows)
    inside, y = np.zeros((count, length), bool), np.zeros((count, length))
    rows, cols, feats = [], [], []
    for r, (part, labels) in enumerate(windows):
        inside[r, : len(part)] = True
        y[r, : len(part)] = labels
        for c, own in enumerate(part):
            for f in own:
                rows.append(r)
                cols.append(c)
                feats.append(index[f])
    rows, cols, feats = (np.array(x, int) for x in (rows, cols, feats))
    del windows
    y0 = np.concatenate([np.zeros((count, 1)), y[:, :-1]], 1)
    follows = inside.copy()
    follows[:, 0] = False
    theta = np.concatenate([np.zeros(len(index)), [-4.0, 0.0, 0.0, 0.0]])  # bias, start, enter, stay
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, (bias, start, enter, stay) = theta[:-4], theta[-4:]
        e = np.full((count, length), bias)
        np.add.at(e, (rows, cols), w[feats])
        t = np.exp([[0.0, enter], [0.0, stay]])
        alpha, beta = np.zeros((count, length, 2)), np.ones((count, length, 2))
        emit = np.stack([np.ones_like(e), np.exp(np.clip(e, -30, 30))], 2)
        alpha[:, 0] = np.exp([0.0, start]) * emit[:, 0]
        alpha[:, 0] /= alpha[:, 0].sum(1, keepdims=True)
        for k in range(1, length):
            a = alpha[:, k - 1] @ t * emit[:, k]
            alpha[:, k] = a / a.sum(1, keepdims=True)
        for k in range(length - 2, -1, -1):
            b = (emit[:, k + 1] * beta[:, k + 1]) @ t.T
            b = np.where(inside[:, k + 1, None], b, 1.0)
            beta[:, k] = b / b.sum(1, keepdims=True)
        p = alpha * beta
        p = (p / p.sum(2, keepdims=True))[:, :, 1]
        pair = alpha[:, :-1, :, None] * t * (emit[:, 1:] * beta[:, 1:])[:, :, None, :]
        pair /= pair.sum((2, 3), keepdims=True)
        gap = np.where(inside, y - p, 0.0)
        gw = np.bincount(feats, gap[rows, cols], len(index)) if len(index) else np.zeros(0)
        on = follows[:, 1:]
        g = np.concatenate([gw, [gap.sum(), gap[:, 0].sum(), (on * ((1 - y0[:, 1:]) * y[:, 1:] - pair[:, :, 0, 1])).sum(), (on * (y0[:, 1:] * y[:, 1:] - pair[:, :, 1, 1])).sum()]])
        g -= 0.1 * theta
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        theta = theta + 0.15 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    out = Field({f: float(theta[i]) for f, i in index.items()}, *(float(x) for x in theta[-4:]))
    scorer = Scorer(out)
    z = np.array([[1.0, *out.summary(scorer.marginals(x)[1])] for x in [*toxic, *clean]])
    label = np.array([1.0] * len(toxic) + [0.0] * len(clean))
    weight = np.array([shares[0]] * len(toxic) + [shares[1]] * len(clean))
    curve, least = np.zeros(3), np.diag([1e-3, 1e-2, 1e-2])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ curve, -30, 30)))
        h = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + least
        curve = curve + np.clip(np.linalg.solve(h, z.T @ (weight * (label - p)) - least @ curve), -2, 2)
    out.curve = tuple(float(x) for x in curve)
    return out


def train(docs: DataFrame, labels: DataFrame, held_out: Column, max_per_class: int = MAX_PER_CLASS, max_bytes: int = MAX_BYTES) -> Field:
    """A field from labelled documents outside ``held_out`` (a condition on ``doc_id``)."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    picked = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_per_class) for c in (0, 1)]
    sample = F.broadcast(picked[0].unionByName(picked[1]))  # 2 * max_per_class rows at most
    texts = docs.select("doc_id", text_of().alias("text")).join(sample, "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    # 2 * max_per_class rows at most, read twice: their sizes first, then the texts that fit.
    texts = checkpointed(texts.where(F.octet_length("text") <= max_bytes))
    left, fits = {0: max_bytes, 1: max_bytes}, []
    for doc_id, toxic, size in texts.orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id", "toxic", F.octet_length("text")).collect():
        if size <= left.get(toxic, -1):
            left[toxic] -= size
            fits.append((doc_id,))
    held = texts.join(F.broadcast(docs.sparkSession.createDataFrame(fits, texts.select("doc_id").schema)), "doc_id")
    rows = held.select("doc_id", "toxic", "text").orderBy("doc_id").collect()
    by = {c: [r["text"] for r in rows if r["toxic"] == c] for c in (0, 1)}
    for c in (0, 1):
        if counts.get(c) and not by[c]:
            warnings.warn(f"toxicity: none of the {counts[c]} documents labelled {c} can be learnt from: not there, or above {max_bytes} bytes", stacklevel=2)
    return fit(by[1], by[0], tuple(counts.get(c, 0) / max(len(by[c]), 1) for c in (1, 0)))


def score(docs: DataFrame, fitted: Field, threshold: float = PREDICT_AT, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """(doc_id, score, predicted, spans) of every document; ``keep``: the input's columns instead, of rows not predicted."""
    bound_batches(docs.sparkSession)
    own = F.struct(*docs.columns) if keep else F.col(id_col)
    rows = docs.select(own.alias("doc_id"), text_of(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(fitted)
        for batch in released(batches):
            found = [scorer(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in found], pa.float64()), pa.array([int(s >= threshold) for s, _ in found], pa.int32()), pa.array([x for _, x in found], span)], ["doc_id", "score", "predicted", "spans"])

    out = rows.mapInArrow(run, f"doc_id {kind}, score double, predicted int, spans array<struct<start:long,end:long,p:double>>")
    return out.where(F.col("predicted") == 0).select("doc_id.*") if keep else out
