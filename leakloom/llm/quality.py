"""Quality rules: learned decision lists over native text statistics.

Sequential covering on the driver, over the statistics of a bounded sample of labelled documents
(``max_rows`` whose id has the smallest hash; numbers only, no texts): a rule grows by the threshold
with the best information gain until it covers no clean row, is pruned on rows that it wasn't grown on, and joins the list while
it is precise enough; then the rows it covers go. The list becomes one Spark CASE expression, read
from the top, that keeps what no rule rejects. Statistics, rules and verdicts are SQL functions.

Defined cases: a null or empty text has no words and fails the base rule; null labels are skipped,
of a document's labels the smallest counts; without labels of both classes the list is empty; null
and repeated ids are kept; an empty table gives no rows; other columns are untouched, and a column
whose name clashes with a statistic's is never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, let, text_of

WINDOW = 5
#: Bits of a long that hold a window's place; the others hold the beginning of its hash.
PLACE_BITS = 24
#: Labelled rows that learning takes at most.
MAX_ROWS = 20_000
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Precision that a rule must have on the rows it is pruned on, and rows it must cover there.
LEAST_PRECISION, LEAST_COVER = 0.95, 5
RATIOS = ("n_words", "word_length", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "digit_ratio", "mark_ratio")


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def repeated_words(words: Column, size: int = WINDOW) -> Column:
    """Words inside windows of ``size`` words that occur twice or more, the first one included.

    Windows are compared by a 64-bit hash. Texts without an equal pair of windows stop after a hash set. For
    others one long per window is sorted, the hash's first 40 bits and the window's place in the rest, and
    neighbours are compared by their whole hashes; where two hashes share those bits, or a text has more
    windows than places, hashes and places are sorted as they are. So the cost is n log n.
    """
    low = (1 << PLACE_BITS) - 1

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda x, i: F.least(F.lit(size), F.coalesce(F.get(at, i + 1) - x, F.lit(size)).cast("int")))
        return F.aggregate(gaps, F.lit(0), lambda acc, x: acc + x)

    def plainly(hashes: Column) -> Column:
        def of(s: Column) -> Column:
            twice = F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
            return let(F.sort_array(F.transform(twice, lambda x: x["i"])), covered)

        return let(F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), of)

    def count(hashes: Column) -> Column:
        place = lambda x: x.bitwiseAND(F.lit(low)).cast("int")
        whole = lambda x: F.get(hashes, place(x))
        first = lambda x: F.shiftright(x, PLACE_BITS)

        def of(s: Column) -> Column:
            mixed = F.exists(F.transform(s, lambda x, i: (i > 0) & (first(x) == first(F.get(s, i - 1))) & (whole(x) != whole(F.get(s, i - 1)))), lambda x: x)
            twice = F.filter(s, lambda x, i: ((i > 0) & (whole(F.get(s, i - 1)) == whole(x))) | F.coalesce(whole(F.get(s, i + 1)) == whole(x), F.lit(False)))
            return F.when(F.coalesce(mixed, F.lit(False)), plainly(hashes)).otherwise(let(F.sort_array(F.transform(twice, place)), covered))

        packed = F.transform(hashes, lambda x, i: x.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).when(F.size(hashes) > low, plainly(hashes)).otherwise(let(F.sort_array(packed), of))

    starts = F.sequence(F.lit(0), F.size(words) - size)
    windows = F.transform(starts, lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(size))))
    return F.when(F.size(words) > size, let(windows, count)).otherwise(F.lit(0)).cast("long")


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents in a struct ``row``, and columns of base statistics and further ones, all long.

    They pass through ``inline``, so that a filter on them isn't pushed below and makes them twice.
    """
    text = F.col("__text")
    rows = docs.select(F.struct(*docs.columns).alias("row"), text_of(text_col).alias("__text"))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    n = F.length(text)
    own = {
        "word_chars": _without(text, BLANKS),
        "n_symbols": n - _without(text, SYMBOLS),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_breaks": n - _without(text, "\n"),
        "n_upper": n - _without(text, UPPER),
        "n_digits": n - _without(text, "0123456789"),
        "n_marks": n - _without(text, "!?;:"),
    }
    by_word = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    made = rows.select("row", F.inline(F.array(F.struct(by_word.alias("__words"), *(c.cast("long").alias(k) for k, c in own.items())))))
    return made.select("row", "__words.n_words", "__words.n_repeat_words", *own)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def ratios() -> dict[str, Column]:
    """What the rules' thresholds are on, from ``statistics``' columns."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    own = (F.col("n_words").cast("double"), F.col("word_chars") / words, F.col("n_symbols") / chars, F.col("n_dup_lines") / (F.col("n_breaks") + 1), F.col("n_repeat_words") / words, F.col("n_upper") / chars, F.col("n_digits") / chars, F.col("n_marks") / chars)
    return dict(zip(RATIOS, own, strict=True))


@dataclass(frozen=True)
class Rule:
    """Reject where every (statistic, "<=" or ">", threshold) holds."""

    terms: tuple[tuple[str, str, float], ...]

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, op, t in self.terms:
            out &= x[name] <= t if op == "<=" else x[name] > t
        return out

    def expression(self) -> Column:
        own, out = ratios(), F.lit(True)
        for name, op, t in self.terms:
            out &= own[name] <= F.lit(t) if op == "<=" else own[name] > F.lit(t)
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {op} {t:.6g}" for n, op, t in self.terms)


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Add the term with the best information gain until no clean row is covered."""
    terms: list[tuple[str, str, float]] = []
    inside = np.ones(len(bad), bool)
    while (~bad[inside]).any() and bad[inside].any():
        p0, n0 = bad[inside].sum(), inside.sum()
        best = (0.0, None)
        for name, values in x.items():
            v = values[inside]
            order = np.argsort(v, kind="stable")
            s, good_left = v[order], np.cumsum(bad[inside][order])
            cut = np.flatnonzero(s[1:] > s[:-1])
            if not len(cut):
                continue
            for op, p, n in (("<=", good_left[cut], cut + 1), (">", p0 - good_left[cut], n0 - cut - 1)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / n) - np.log2(p0 / n0)), 0.0)
                k = int(np.argmax(gain))
                if gain[k] > best[0] + 1e-9:
                    best = (float(gain[k]), (name, op, float((s[cut[k]] + s[cut[k] + 1]) / 2)))
        if best[1] is None:
            break
        terms.append(best[1])
        inside &= Rule((best[1],)).covers(x)
    return Rule(tuple(terms))


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The beginning of the rule with the best (p - n) / (p + n) on other rows; the shortest of equals."""

    def worth(k: int) -> float:
        c = Rule(rule.terms[:k]).covers(x)
        p, n = (c & bad).sum(), (c & ~bad).sum()
        return (p - n) / (p + n) if p + n else -1.0

    lengths = range(1, len(rule.terms) + 1)
    return Rule(rule.terms[: max(lengths, key=lambda k: (worth(k), -k))]) if rule.terms else rule


def learn_list(x: dict[str, np.ndarray], bad: np.ndarray, least_precision: float = LEAST_PRECISION, least_cover: int = LEAST_COVER) -> list[Rule]:
    """Sequential covering; every third row prunes and the others grow."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    holds = np.arange(len(bad)) % 3 == 2
    while bad[left].any():
        part = lambda m: {k: v[m] for k, v in x.items()}
        grow, prune = left & ~holds, left & holds
        rule = _prune(_grow(part(grow), bad[grow]), part(prune), bad[prune])
        if not rule.terms:
            break
        c = rule.covers(x) & left
        own = c & prune
        if own.sum() < least_cover or bad[own].mean() < least_precision or bad[c].mean() < least_precision:
            break
        rules.append(rule)
        left &= ~c
    return rules


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> list[Rule]:
    """A decision list from documents with a quality label; rows that the base rule rejects are left out."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))  # max_rows rows at most
    texts = docs.select("doc_id", text_of().alias("text")).join(sample, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))
    stats = statistics(texts).where(~base_failed()).select(F.xxhash64("row.doc_id").alias("__order"), (F.col("row.quality") == 0).alias("__bad"), *(c.alias(k) for k, c in ratios().items()))
    rows = stats.orderBy("__order").limit(max_rows).collect()
    if not rows:
        return []
    return learn_list({k: np.array([r[k] for r in rows], float) for k in RATIOS}, np.array([r["__bad"] for r in rows], bool))


def verdict(rules: list[Rule]) -> Column:
    """The ordered conditional expression: false at the first rule that holds, else true."""
    out = F.when(base_failed(), F.lit(False))
    for rule in rules:
        out = out.when(rule.expression(), F.lit(False))
    return out.otherwise(F.lit(True))


def assess(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """``statistics`` with ``base_failed`` and ``kept``."""
    return statistics(docs, text_col).select("*", base_failed().alias("base_failed"), verdict(rules).alias("kept"))


def keep(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """The documents that no rule rejects."""
    return assess(docs, rules, text_col).where("kept").select("row.*")
