"""Secrets in texts: patterns, and sliding-window Shannon entropy, as SQL functions.

Base kinds are leftmost, non-overlapping matches of a pattern; failing ones are dropped. A text that
a kind's cheap condition doesn't hold for costs one pass of that condition. Candidate strings (long
runs of key characters with a digit) have their entropy taken in every window of ``WINDOW``
characters, by counts that change by one character at a step; a run with a window that reaches the
threshold of its character class is a span of kind ``entropy`` unless the allow-list knows its shape
or a base span overlaps it.

Offsets are code points, ends exclusive: a match starts after the lengths of all gaps and matches
before it. Work is in proportion to a text and its matches, whatever their number and length: sums and
maxima over matches are taken chunk by chunk, long words and texts are cut into pieces before single
characters are looked at, and no pattern repeats a group (which Java matches by recursion).

Defined cases: a null or empty text has no spans; null and repeated ids are kept; an empty table
gives no rows; other columns are untouched, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of


def _either(word: str) -> str:
    """A pattern for ASCII letters in either case, the same in every regex dialect."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([*map(_either, ("password", "passwd", "secret", "token")), _either("api") + "_?" + _either("key")])
#: kind: (condition that a text with a match meets, pattern, group whose length counts, least length).
BASE = {
    "assign": (rf"""(?:{_NAMES})[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?[A-Za-z0-9+/_.=-]""", rf"""({_NAMES})[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]{16}", r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"(?<![0-9a-f])[0-9a-f]{24}", r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24),
}
KINDS = (*BASE, "entropy")
WINDOW = 20
_KEY = "A-Za-z0-9+/_=-"
CANDIDATE = rf"(?<![{_KEY}])(?=[A-Za-z+/_=-]*[0-9])[{_KEY}]{{{WINDOW},}}"
#: Characters of each class, the pattern of strings that belong to it, and the least entropy in bits; the first that fits counts.
CLASSES = {
    "hex": ("0123456789abcdef", r"^(?:[0-9a-f]+|[0-9A-F]+)$", 3.0),
    "key": ("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-", r"[A-Za-z]", 3.6),
}
#: Shapes that aren't secrets: numbers, UUIDs, placeholders; ``joined`` tells words and numbers joined by signs.
ALLOWED = (
    r"^[0-9+/_=-]+$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example|placeholder|changeme|dummy|sample|your[-_]|(.)\1{7}|01234567|12345678|abcdefgh",
)
#: A candidate starts with a letter or digit and has no letter beside a digit: words and numbers joined by signs.
JOINED, MIXED = r"^[A-Za-z0-9]", r"[A-Za-z][0-9]|[0-9][A-Za-z]"
MASK = "[SECRET]"
SPAN = "array<struct<start:int,end:int,rank:int>>"
#: Elements of a chunk of ``running``, and code points of a piece of a long text or word.
CHUNK, PIECE = 64, 1024


# Expressions are made as SQL text: one that is put together call by call takes the driver seconds.


def _raw(pattern: str) -> str:
    """A pattern as a SQL literal; it has no quotation mark."""
    return f"r'{pattern}'"


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` for a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def running(values: str, merge: str, zero: int = 0) -> str:
    """``merge`` (of ``a`` and ``b``) of each integer and all before it, as an array.

    An array that grows in a fold is copied at every step; chunks bound the copies, so that n values
    cost some ``CHUNK`` * n + (n / ``CHUNK``)^2 / 2 copied integers.
    """
    none = "cast(array() as array<int>)"

    def fold(part: str, first: str) -> str:
        step = _let("at", _let("a", "acc.at", merge), "named_struct('at', at, 'out', concat(acc.out, array(at)))")
        return f"aggregate({part}, named_struct('at', {first}, 'out', {none}), (acc, b) -> {step}, acc -> acc.out)"

    chunks = f"transform(sequence(0, cast(floor((size(v) - 1) / {CHUNK}) as int)), k -> slice(v, k * {CHUNK} + 1, {CHUNK}))"
    sums = f"transform(c, p -> aggregate(p, {zero}, (a, b) -> {merge}))"
    by_chunk = _let("c", chunks, _let("ends", fold(sums, str(zero)), f"flatten(transform(c, (p, k) -> {fold('p', f'if(k = 0, {zero}, get(ends, k - 1))')}))"))
    return _let("v", values, f"if(size(v) = 0, {none}, if(size(v) > {CHUNK}, {by_chunk}, {fold('v', str(zero))}))")


def _spans(text: str, condition: str, pattern: str, passes: str, rank: int) -> str:
    """Spans of a pattern's matches of which ``passes`` (a condition on ``whole`` and ``value``) holds."""
    matches = lambda group: f"regexp_extract_all({text}, {_raw(pattern)}, {group})"
    groups = f"named_struct('whole', {matches(0)}, 'gaps', split({text}, {_raw(pattern)}, -1), 'value', {matches(2 if rank == 0 else 0)})"
    ends = running("transform(f.whole, (w, i) -> char_length(get(f.gaps, i)) + char_length(w))", "a + b")
    held = _let("value", "get(f.value, i)", f"if({passes}, {rank}, -1)")
    one = f"named_struct('start', get(n, i) - char_length(whole), 'end', get(n, i), 'rank', {held})"
    every = _let("f", groups, _let("n", ends, f"filter(transform(f.whole, (whole, i) -> {one}), s -> s.rank >= 0)"))
    return f"if({text} rlike {_raw(condition)}, {every}, cast(array() as {SPAN}))"


def window_entropy(value: str, alphabet: str, window: int = WINDOW) -> str:
    """The largest Shannon entropy, in bits, of ``window`` neighbouring characters of a string.

    With counts n of a window's characters the entropy is log2(w) - sum(n log2 n) / w; a step adds a
    character and takes the oldest away, so it changes two counts and the sum.
    """
    weights = ", ".join(f"{n * math.log2(n) if n else 0.0!r}D" for n in range(window + 2))
    gain = lambda n, by: f"get(array({weights}), {n} + {by}) - get(array({weights}), {n})"
    lost = f"if(old >= 0, {_let('k', 'get(acc.counts, old)', gain('k', -1))}, 0D)"
    total = f"acc.total + if(new = old, 0D, {_let('k', 'get(acc.counts, new)', gain('k', 1))} + {lost})"
    counts = "transform(acc.counts, (k, at) -> k + if(at = new, 1, 0) - if(at = old, 1, 0))"
    best = f"if(i >= {window - 1}, greatest(acc.best, {math.log2(window)!r}D - sum / {window}), acc.best)"
    step = _let("new", "get(m, i)", _let("old", f"if(i >= {window}, get(m, i - {window}), -1)", _let("sum", total, f"named_struct('counts', {counts}, 'total', sum, 'best', {best})")))
    first = f"named_struct('counts', array_repeat(0, {len(alphabet)}), 'total', 0D, 'best', 0D)"
    over = f"aggregate(sequence(0, size(m) - 1), {first}, (acc, i) -> {step}, acc -> acc.best)"
    return f"if(char_length({value}) >= {window}, {_let('m', f"transform(split({value}, ''), c -> locate(c, '{alphabet}') - 1)", over)}, 0D)"


def _pieces(text: str) -> str:
    """A text in pieces of ``PIECE`` code points; the last one may be shorter."""
    return f"regexp_extract_all({text}, r'(?s).{{1,{PIECE}}}', 0)"


def reaches(value: str, alphabet: str, least: float, window: int = WINDOW) -> str:
    """Whether a window of a string reaches an entropy. Strings are read piece by piece, up to the first that does."""
    lapped = f"transform(r, (x, i) -> if(i = 0, x, concat(right(get(r, i - 1), {window - 1}), x)))"
    return _let("r", _pieces(value), f"exists({lapped}, x -> {window_entropy('x', alphabet, window)} >= {least})")


def suspicious(value: str) -> str:
    """Whether a candidate string reaches its class's entropy and no allowed shape fits it."""
    classes = " ".join(f"when {value} rlike {_raw(belongs)} then {reaches(f'lower({value})' if len(alphabet) == 16 else value, alphabet, least)}" for alphabet, belongs, least in CLASSES.values())
    allowed = " or ".join([f"({value} rlike {_raw(JOINED)} and not {value} rlike {_raw(MIXED)})", *(f"{value} rlike {_raw(x)}" for x in ALLOWED)])
    return f"case when {allowed} then false {classes} else false end"


def _sorted(spans: str) -> str:
    """By start, then kind."""
    by = f"sort_array(transform({spans}, s -> named_struct('start', s.start, 'rank', s.rank, 'end', s.`end`)))"
    return f"transform({by}, s -> named_struct('start', s.start, 'end', s.`end`, 'rank', s.rank))"


def _apart(base: str, more: str) -> str:
    """Those of ``more`` that no span of ``base`` overlaps: of the spans before, the largest end; of those behind, the smallest start."""
    last, own = 2**31 - 1, f"s.rank = {len(BASE)}"
    ends = running(f"transform(both, s -> if({own}, 0, s.`end`))", "greatest(a, b)")
    starts = running(f"reverse(transform(both, s -> if({own}, {last}, s.start)))", "least(a, b)", last)
    free = f"filter(both, (s, i) -> {own} and get(before, i) <= s.start and get(behind, i) >= s.`end`)"
    every = _let("both", _sorted(f"concat({base}, {more})"), _let("before", ends, _let("behind", f"reverse({starts})", free)))
    return f"if(size({base}) = 0 or size({more}) = 0, {more}, {every})"


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents in a struct ``row``, the text, and ``base`` and ``spans``: sorted arrays of (start, end, rank in ``KINDS``)."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), text_of(text_col).alias("__text"))
    found = [_spans("__text", condition, pattern, f"char_length(value) >= {least}", rank) for rank, (condition, pattern, _, least) in enumerate(BASE.values())]
    entropy = _spans("__text", CANDIDATE, CANDIDATE, suspicious("whole"), len(BASE))
    rows = rows.select("row", "__text", F.expr(f"inline(array(named_struct('base', {_sorted(f'concat({", ".join(found)})')}, 'more', {entropy})))"))
    return rows.select("row", "__text", F.expr(f"inline(array(named_struct('base', base, 'spans', {_sorted(f'concat(base, {_apart("base", "more")})')})))"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["rank"]), x["start"].cast("string"), x["end"].cast("string"))))


def _cut(start: str, end: str) -> str:
    """The code points ``start`` to ``end`` of the text in the pieces ``r``; only pieces at the edges are walked through."""
    at = lambda x: f"cast(floor(({x}) / {PIECE}) as int)"
    head = f"substring(get(r, {at('x')}), x % {PIECE} + 1, {PIECE})"
    middle = f"array_join(slice(r, {at('x')} + 2, {at('y')} - {at('x')} - 1), '')"
    tail = f"coalesce(substring(get(r, {at('y')}), 1, y % {PIECE}), '')"
    one = f"substring(get(r, {at('x')}), x % {PIECE} + 1, y - x)"
    return _let("x", start, _let("y", end, f"case when y <= x then '' when {at('x')} = {at('y')} then {one} else concat({head}, {middle}, {tail}) end"))


def redact(docs: DataFrame, text_col: str = "text", count_col: str | None = "n_chars") -> DataFrame:
    """The documents, each span of a text replaced by ``MASK`` (overlapping ones once)."""
    part = _let("begin", "if(i = 0, 0, get(n, i - 1))", f"if(s.start >= begin, concat({_cut('begin', 's.start')}, '{MASK}'), '')")
    rest = _cut("element_at(n, -1)", "char_length(__text)")
    ends = running("transform(spans, s -> s.`end`)", "greatest(a, b)")
    masked = _let("r", _pieces("__text"), _let("n", ends, f"concat(array_join(transform(spans, (s, i) -> {part}), ''), {rest})"))
    rows = scan(docs, text_col).select("row", F.expr(f"if(size(spans) > 0, {masked}, null)").alias("__masked"))
    new = {text_col: F.coalesce(F.col("__masked"), F.col("row")[text_col])}
    if count_col in docs.columns:
        new[count_col] = F.when(F.col("__masked").isNotNull(), F.length("__masked").cast(docs.schema[count_col].dataType)).otherwise(F.col("row")[count_col])
    return rows.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
