"""The detect stage: one Python pass per partition, from contents to findings.

Contents are matched against the lower-case keywords by an automaton; a detector runs on the texts of some MB that
have one of its keywords, all of them at once, on an engine whose time is linear in the text. Candidates
are filtered, located and fingerprinted. The same runs on payloads of base64 runs, which are reported
where the run is. Duplicates in a file are dropped on the way, so the stage is narrow and its output
small; only findings are ever shuffled.
"""

from __future__ import annotations

import hashlib
import re
import urllib.request
import uuid
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import findings as shape
from ..functions import examples, linear, patterns, plausible
from ..sources import tables
from .registry import Detector, load

GENERIC = "generic-assigned-secret"
#: Base64 runs from 20 characters on, up to this many.
MAX_ENCODED = 8192
ENCODED = "≥20×A-Za-z0-9+/_- 0–2×="
_ENCODED = linear.form(patterns.within("< SECRET >", ENCODED, ""))
SNIFF = 8000
#: Characters of text that detectors see at once; a single text is never split. A pattern is compiled anew for each call of the engine,
#: some milliseconds for each of a thousand detectors, so a whole scan sees more of them than one or two detectors need.
TOGETHER, SCANNED = 4 << 20, 24 << 20
#: Bytes of a batch that Spark sends for one or two detectors: more would only wait in the worker.
SENT = 8 << 20
SCHEMA = "detector_id string, name string, severity string, file string, commit string, line int, column int, secret string, redacted string, verified boolean, fingerprint string, view int, start long"


@dataclass
class Plan:
    """Detectors by keyword, with an automaton where the library is there."""

    detectors: tuple[Detector, ...]

    def __post_init__(self) -> None:
        self.always = [i for i, d in enumerate(self.detectors) if not d.usable_keywords]
        #: Detectors by keyword; a keyword with blanks around it, which the automaton doesn't know, must be there with them.
        self.by_keyword: dict[str, list[tuple[int, str]]] = {}
        for i, d in enumerate(self.detectors):
            for k in d.keywords:
                if own := k.strip().lower():
                    self.by_keyword.setdefault(own, []).append((i, "" if own == k.lower() else k.lower()))
        self.automaton = None
        try:
            import ahocorasick
        except ImportError:
            return
        if self.by_keyword:
            self.automaton = ahocorasick.Automaton()
            for k in self.by_keyword:
                self.automaton.add_word(k, k)
            self.automaton.make_automaton()

    def keywords_in(self, text: str) -> set[str]:
        low = text.lower()
        if self.automaton is not None:
            return {k for _, k in self.automaton.iter(low)}
        return {k for k in self.by_keyword if k in low}

    def select(self, text: str) -> list[int]:
        """Numbers of the detectors to run, ascending: those with a keyword in the text, and those without keywords."""
        on, low = set(self.always), text.lower()
        for k in self.keywords_in(low):
            on.update(i for i, padded in self.by_keyword[k] if not padded or padded in low)
        return sorted(on)


@lru_cache(8)
def _plan(name: str, holder: _Held) -> Plan:
    return Plan(holder.detectors)


class _Held:
    """Detectors that don't count in a cache's key."""

    def __init__(self, detectors: tuple[Detector, ...]) -> None:
        self.detectors = detectors

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Held)

    def __hash__(self) -> int:
        return 0


def plan_of(name: str, detectors: tuple[Detector, ...]) -> Plan:
    """One plan per worker process and set of detectors; the last few are kept."""
    return _plan(name, _Held(detectors))


def found_in(plan: Plan, texts: list[str]) -> list[list[tuple[Detector, int, int, str]]]:
    """(detector, start, end, secret) of the plausible matches in each text, by detector and place; offsets in code points."""
    out: list[list[tuple[Detector, int, int, str]]] = [[] for _ in texts]
    rows: dict[int, list[int]] = {}
    for row, text in enumerate(texts):
        for i in plan.select(text):
            rows.setdefault(i, []).append(row)
    column = pa.array([linear.searchable(text) for text in texts], pa.large_string())
    for i in sorted(rows):
        d, own = plan.detectors[i], rows[i]
        if d.find is not None:
            for row in own:
                out[row] += [(d, *found) for found in d.find(texts[row])]
            continue
        for k, start, end, first in d.spans(column if len(own) == len(texts) else column.take(pa.array(own))):
            text = texts[own[k]]
            secret = text[start:end]
            if d.broad_context and not d.custom and plausible.crosses_blank_line(text[first:start]):
                continue
            if plausible.is_plausible(secret) and not (d.id == GENERIC and plausible.is_assigned_reference(text, start)):
                out[own[k]].append((d, start, end, secret))
    return out


def candidates(detector: Detector, text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, secret) of a detector's plausible matches, whatever its keywords; offsets in code points."""
    for _, *found in found_in(Plan((replace(detector, keywords=()),)), [text])[0]:
        yield tuple(found)


def is_binary(data: bytes) -> bool:
    return b"\0" in data[:SNIFF]


def _encoded(texts: list[str]) -> Iterator[tuple[int, int, str]]:
    """(text, where the run is, decoded text) of each text's new base64 payloads that are text."""
    seen = set()
    for row, start, end, _ in linear.spans(pa.array([linear.searchable(text) for text in texts], pa.large_string()), _ENCODED):
        if end - start > MAX_ENCODED:
            continue
        data = plausible.decode_base64(texts[row][start:end])
        if data is None or len(data) < 8 or is_binary(data) or (row, data) in seen:
            continue
        seen.add((row, data))
        yield row, start, data.decode("utf-8", "surrogateescape")


def scan_texts(plan: Plan, texts: list[str]) -> Iterator[list[tuple[Detector, str, int, int]]]:
    """(detector, secret, start, view) of each text's findings: raw text first, each (detector, secret) once."""
    for lo, hi in together(texts, SCANNED):
        own = texts[lo:hi]
        found = [[(d, secret, start, 0) for d, start, _, secret in x] for x in found_in(plan, own)]
        payloads = list(_encoded(own))
        decoded = [text for _, _, text in payloads]
        for a, b in together(decoded, SCANNED):
            for (row, at, _), x in zip(payloads[a:b], found_in(plan, decoded[a:b])):
                found[row] += [(d, secret, at, 1) for d, _, _, secret in x]
        for x in found:
            yield list({(d.id, secret): (d, secret, start, view) for d, secret, start, view in reversed(x)}.values())[::-1]


def together(texts: list[str], most: int = TOGETHER) -> Iterator[tuple[int, int]]:
    """Bounds of slices of whole texts, each of at most ``most`` characters or one text."""
    return _slices([len(text) for text in texts], most)


def _slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    begin = held = 0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield begin, i
            begin, held = i, 0
        held += size
    if begin < len(sizes):
        yield begin, len(sizes)


def cut(batches: Iterable[pa.RecordBatch], texts: int, most: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """The batches as slices without a copy, each with at most ``most`` bytes in the column ``texts`` or one row, whatever the session's batches hold."""
    for batch in batches:
        for lo, hi in _slices(pc.fill_null(pc.binary_length(batch.column(texts)), 0).to_pylist(), most):
            yield batch.slice(lo, hi - lo)
        batch = None
        pa.default_memory_pool().release_unused()  # what Arrow holds of the batch, as the worker outlives its task


def gathered(batches: Iterable[pa.RecordBatch], texts: int, most: int = SCANNED) -> Iterator[pa.RecordBatch]:
    """The same rows where small batches are put together and large ones cut, up to ``most`` bytes of ``texts``."""
    held, size = [], 0
    for batch in cut(batches, texts, most):
        own = pc.sum(pc.binary_length(batch.column(texts))).as_py() or 0
        if held and size + own > most:
            yield _joined(held)
            held, size = [], 0
        held.append(batch)
        size += own
        batch = None
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.concat_batches(batches)


def scan_text(plan: Plan, text: str) -> list[tuple[Detector, str, int, int]]:
    """The findings of one text."""
    return next(scan_texts(plan, [text]))


def place_of(text: str, start: int, breaks: list[int]) -> tuple[int, int]:
    """(line, column in bytes) of a place, both from 1; ``breaks`` are the places of the text's line breaks."""
    k = bisect_right(breaks, start - 1)
    begin = breaks[k - 1] + 1 if k else 0
    return k + 1, len(text[begin:start].encode("utf-8", "surrogateescape")) + 1


def finding_rows(found: list[tuple[Detector, str, int, int]], text: str, file: str, commit: str) -> list[tuple]:
    """Rows of a text's findings, as ``SCHEMA`` has them."""
    out, breaks = [], None
    for d, secret, start, view in found:
        breaks = [m.start() for m in re.finditer("\n", text)] if breaks is None else breaks
        line, column = place_of(text, start, breaks)
        clean = secret.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        out.append((d.id, d.name, d.severity, file, commit, line, column, clean, shape.redacted_of(secret), False, shape.fingerprint_of(d.id, secret, file, commit), view, start))
    return out


def detect(sources: DataFrame, detectors: tuple[Detector, ...] | None = None, table: str | None = None) -> DataFrame:
    """Findings of ``sources`` (file, commit, content as text or binary); binary files give none."""
    rows = sources.select("file", F.coalesce("commit", F.lit("")).alias("commit"), "content")
    own = tuple(d.plain() for d in (detectors if detectors is not None else load(table)))
    name = uuid.uuid4().hex if any(d.find for d in own) else hashlib.sha256(repr(own).encode()).hexdigest()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = plan_of(name, own)
        kinds = [pa.string()] * 5 + [pa.int32()] * 2 + [pa.string()] * 2 + [pa.bool_(), pa.string(), pa.int32(), pa.int64()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in gathered(batches, 2):
            out, texts, places = [], [], []
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            batch = None
            for file, commit, content in rows:
                if content is None:
                    continue
                if isinstance(content, bytes):
                    if is_binary(content):
                        continue
                    content = content.decode("utf-8", "surrogateescape")
                elif "\0" in content[:SNIFF]:
                    continue
                texts.append(content)
                places.append((file, commit))
            for text, place, found in zip(texts, places, scan_texts(plan, texts)):
                out += finding_rows(found, text, *place)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return rows.mapInArrow(run, SCHEMA)


def spread(table: DataFrame) -> DataFrame:
    """A scanned table, its rows dealt out anew where it has fewer partitions than there are cores.

    Matching takes far longer than moving a text, and such a table is small for the cluster; a larger one stays as it is.
    Some of a scan's partitions may hold no row group, so twice as many as cores count as enough.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(2 * cores) if table.rdd.getNumPartitions() < 2 * cores else table


def documents_as_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.concat(F.lit("documents/"), F.col(id_col).cast("string")).alias("file"), F.lit("").alias("commit"), F.col(text_col).alias("content"))


def bearer_check(url: str, timeout: float = 8.0) -> Callable[[str], bool]:
    """A verifier: whether an address answers 200 to a request that bears the secret."""

    def ask(secret: str) -> bool:
        request = urllib.request.Request(url, headers={"Authorization": f"Bearer {secret}"})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as r:
                return r.status == 200
        except (OSError, ValueError):
            return False

    return ask


#: Addresses that tell whether a token of the detectors named is live. Only asked on demand.
VERIFIED_AT = {
    "https://api.github.com/user": ("github-token", "github-pat-v2"),
    "https://api.openai.com/v1/models": ("openai-key", "openai-admin-key"),
}


def verifiers(detectors: tuple[Detector, ...]) -> dict[str, Callable[[str], bool]]:
    """Verifiers of those detectors that are verifiable, by detector id."""
    marked = {d.id for d in detectors if d.verifiable}
    return {i: bearer_check(url) for url, ids in VERIFIED_AT.items() for i in ids if i in marked}


def verify(found: DataFrame, verifiers: dict, store: str | None = None, max_age: str = "30 days", lanes: int = 4) -> DataFrame:
    """``verified`` by callables per detector id; each distinct (detector, secret) is asked once.

    At most ``lanes`` tasks ask for a detector at a time, each one secret after the other. With a ``store``, a folder that runs share,
    secrets found live are kept there under a hash, and aren't asked for again until ``max_age`` has gone by; others are never kept, so
    they are asked for again. The questions are then asked at once, before the result is used.
    """
    if not verifiers:
        return found
    spark, key = found.sparkSession, F.sha2(F.concat_ws("\0", "detector_id", "secret"), 256)
    asked = found.where(F.col("detector_id").isin(*verifiers)).select("detector_id", "secret").where("secret IS NOT NULL").distinct()
    kept = None
    if store is not None:
        known = "key string, asked_at timestamp"
        kept = spark.createDataFrame([], known) if not tables.exists(spark, store) else spark.read.schema(known).parquet(store)
        kept = kept.where(F.col("asked_at") > F.current_timestamp() - F.expr(f"INTERVAL {max_age}")).select(F.col("key").alias("__key")).distinct()
        asked = tables.written(asked.withColumn("__key", key).join(kept.withColumn("__kept", F.lit(True)), "__key", "left").drop("__key"), "asked")
    questions = asked.where("__kept IS NULL") if store is not None else asked
    dealt = questions.select("detector_id", "secret").repartition("detector_id", F.pmod(F.xxhash64("secret"), F.lit(lanes)))

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, secrets = (c.to_pylist() for c in batch.columns)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([bool(verifiers[i](s)) for i, s in zip(ids, secrets)], pa.bool_())], ["detector_id", "secret", "__ok"])

    answers = dealt.mapInArrow(ask, "detector_id string, secret string, __ok boolean")
    if store is not None:
        answers = tables.written(answers, "answers")
        answers.where("__ok").select(key.alias("key"), F.current_timestamp().alias("asked_at")).write.mode("append").parquet(store)
        answers = answers.unionByName(asked.where("__kept").select("detector_id", "secret", F.lit(True).alias("__ok")))
    return found.join(answers, ["detector_id", "secret"], "left").withColumn("verified", F.coalesce("__ok", F.lit(False))).drop("__ok").select(found.columns)


def example(detector: Detector, tries: int = 200) -> tuple[str, str]:
    """(text, secret): a text made after the detector's pattern in which it finds that secret; always the same one.

    With a keyword in front where the pattern has none. ValueError if none of the tries is found: the detector can't work.
    """
    words = "".join(f" {k}" for k in detector.keywords[:1])
    for k in range(tries):
        text = examples.example(detector.pattern, re.IGNORECASE if detector.ignore_case else 0, (detector.id, k))
        if not any(x.lower() in text.lower() for x in detector.keywords):
            text += words
        found = found_in(Plan((detector,)), [f" {text}\n"])[0]
        if found:
            return text, found[0][3]
    raise ValueError(f"no example of detector {detector.id} is found")


def matches(texts: DataFrame, detectors: tuple[Detector, ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, detector_id, secret, before, line, column) of every match of the detectors' patterns, plausible or not, repeats included.

    ``before`` is the match up to its secret, whose place is given. The detectors run on every text, whatever their keywords; null texts give nothing.
    """
    own = tuple(d.plain() for d in detectors)
    kind = dict(texts.dtypes)[id_col]
    texts.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", SENT)  # of the session's next Python stages
    rows = texts.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "detector_id", "secret", "before", "line", "column"]
        for batch in cut(batches, 1):
            ids, values = batch.column(0), batch.column(1).to_pylist()
            batch = None
            column, breaks = pa.array([linear.searchable(text) for text in values], pa.large_string()), {}
            for d in own:
                out = []
                for row, start, end, first in d.spans(column):
                    text = values[row]
                    if row not in breaks:
                        breaks[row] = [m.start() for m in re.finditer("\n", text)]
                    out.append((row, d.id, text[start:end], text[first:start], *place_of(text, start, breaks[row])))
                if out:
                    at, *columns = zip(*out)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), *(pa.array(c, k) for c, k in zip(columns, [pa.string()] * 3 + [pa.int64()] * 2))], names)

    return rows.mapInArrow(run, f"id {kind}, detector_id string, secret string, before string, line long, column long").withColumnRenamed("id", id_col)


def encoded_runs(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, run) of every base64 run that may hold a payload, by the rules of the re-scan."""
    run = Detector("base64", "Base64 run", "low", (), patterns.within("< SECRET >", ENCODED, ""))
    rows = matches(texts, (run,), id_col, text_col).select(id_col, F.col("secret").alias("run"))
    body = F.rtrim(F.col("run"), F.lit("="))
    return rows.where((F.length("run") <= MAX_ENCODED) & (F.length(body) % 4 != 1) & ~(F.col("run").rlike("[-_]") & F.col("run").rlike("[+/]")))


def keyword_documents(texts: DataFrame, detectors: tuple[Detector, ...], text_col: str = "text") -> DataFrame:
    """(keyword, documents): in how many texts the prefilter sees each keyword of the detectors."""
    own = tuple(d.plain() for d in detectors)
    name = hashlib.sha256(repr(own).encode()).hexdigest()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, seen = plan_of(name, own), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(plan.keywords_in(text or ""))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["keyword", "n"])

    return texts.select(F.col(text_col).cast("string")).mapInArrow(run, "keyword string, n long").groupBy("keyword").agg(F.sum("n").alias("documents"))
