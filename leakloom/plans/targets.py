"""Many targets in one job: a target is a row, and its findings and its outcome are rows.

A task takes some targets one after the other; each is cloned (if it is an address), walked and scanned where it is, and goes
before the next. Nothing of a target but its findings leaves the task, a target that fails is a row that
says why, and Spark runs as many targets at a time as there are cores. A task's memory is that of one file, of some MB
of text, and, with the history, of the names of one repository's objects; the history of a repository too large for one task is
``scan.of_history``'s.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import findings
from ..operators.detect import SCHEMA, TOGETHER, Plan, finding_rows, is_binary, plan_of, scan_texts
from ..operators.registry import Detector, load
from ..sources import archives, files, git, hosting

ROWS = f"target string, status string, error string, findings long, {SCHEMA}"
_KINDS = [pa.string(), pa.string(), pa.string(), pa.int64(), *[pa.string()] * 5, *[pa.int32()] * 2, *[pa.string()] * 2, pa.bool_(), pa.string(), pa.int32(), pa.int64()]


def walk(root: str, include: list[str], exclude: list[str], max_file: int, packed: bool) -> Iterator[tuple[str, bytes]]:
    """(relative path, content) of a folder's files that the filters let through; unreadable ones are left out. A single file passes as it is."""
    if os.path.isfile(root):
        with open(root, "rb") as f:
            yield os.path.basename(root), f.read()
        return
    if not os.path.isdir(root):
        raise FileNotFoundError(f"{root} is no file or folder")
    wanted = files.path_filter(include, exclude, packed)
    for folder, inner, names in os.walk(root):
        inner[:] = sorted(d for d in inner if d not in files.SKIPPED_FOLDERS)
        for name in sorted(names):
            path = os.path.join(folder, name)
            file = os.path.relpath(path, root).replace(os.sep, "/")
            try:
                if wanted(file) and not os.path.islink(path) and os.path.getsize(path) <= max_file:
                    with open(path, "rb") as f:
                        yield file, f.read()
            except OSError:
                continue


def _found(plan: Plan, sources: Iterable[tuple[str, str, bytes]], limits: archives.Limits | None) -> Iterator[tuple]:
    """Finding rows of (file, commit, content), some MB of text at a time."""
    held: list[tuple[str, str, str]] = []

    def scanned() -> Iterator[tuple]:
        for (file, commit, text), found in zip(held, scan_texts(plan, [text for *_, text in held])):
            yield from finding_rows(found, text, file, commit)
        held.clear()

    for file, commit, content in sources:
        for inner, data in archives.expand(file, content, limits) if limits else [(file, content)]:
            if not is_binary(data):
                held.append((inner, commit, data.decode("utf-8", "surrogateescape")))
        if sum(len(text) for *_, text in held) >= TOGETHER:
            yield from scanned()
    yield from scanned()


def _history(plan: Plan, repo: str, wanted: Callable[[str], bool], max_file: int, limits: archives.Limits | None) -> Iterator[tuple]:
    """Findings of each object at each (commit, path) that has it: the log is read for the objects, then again for their places."""
    first: dict[str, str] = {}

    def fresh() -> Iterator[str]:
        for _, path, oid in git.changes(repo):
            if oid not in first and wanted(path):
                first[oid] = path
                yield oid

    found: dict[str, list[tuple]] = {}
    for row in _found(plan, ((f"{oid}/{first[oid]}", "", content) for oid, content in git.blobs(repo, fresh(), max_file)), limits):
        oid, _, file = row[3].partition("/")
        found.setdefault(oid, []).append((*row[:3], file[len(first[oid]) :], *row[4:]))
    for commit, path, oid in git.changes(repo):
        for row in found.get(oid, ()) if wanted(path) else ():
            file = path.encode("utf-8", "surrogateescape").decode("utf-8", "replace") + row[3]
            yield *row[:3], file, commit, *row[5:10], findings.fingerprint_of(row[0], row[7], file, commit), *row[11:]


def scan_targets(
    spark: SparkSession,
    targets: DataFrame,
    clones: str,
    detectors: tuple[Detector, ...] | None = None,
    history: bool = False,
    include: list[str] = (),
    exclude: list[str] = (),
    max_file: int = files.MAX_FILE,
    limits: archives.Limits | None = None,
    tokens: dict[str, str] | None = None,
    clone: Callable = git.clone,
) -> DataFrame:
    """Rows of ``ROWS``: each finding of each target (``target``: a folder, a file or an address), its status null, and one row per target
    with its status (completed or failed), the number of its findings and the error.

    Repeated targets are scanned once, null and blank ones not at all. ``clones`` is a folder that executors can write to; what is cloned
    there goes after its scan. ``tokens`` has an access token by owner. A failing target keeps the findings it gave before.
    """
    own = tuple(d.plain() for d in (detectors if detectors is not None else load()))
    name = uuid.uuid4().hex if any(d.find for d in own) else hashlib.sha256(repr(own).encode()).hexdigest()
    tokens, include, exclude = dict(tokens or {}), list(include), list(exclude)

    def of(plan: Plan, target: str) -> Iterator[tuple]:
        place, remote = target, hosting.is_remote(target)
        if remote:
            place = os.path.join(clones, uuid.uuid4().hex)
        try:
            if remote:
                clone(target, place, tokens.get(hosting.owner(target).lower()))
            yield from _found(plan, ((file, "", content) for file, content in walk(place, include, exclude, max_file, bool(limits))), limits)
            if history and os.path.isdir(os.path.join(place, ".git")):
                yield from _history(plan, place, files.path_filter(include, exclude, bool(limits)), max_file, limits)
        finally:
            if remote:
                shutil.rmtree(place, ignore_errors=True)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], [x.split()[0] for x in ROWS.split(", ")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = plan_of(name, own)
        for batch in batches:
            for target in batch.column(0).to_pylist():
                rows, count, error = [], 0, None
                try:
                    for row in of(plan, target):
                        rows.append((target, None, None, None, *row))
                        if len(rows) >= 1000:
                            count += len(rows)
                            yield batch_of(rows)
                            rows = []
                except Exception as e:  # a target's failure is a result
                    error = str(e)[:500] or type(e).__name__
                count += len(rows)
                yield batch_of([*rows, (target, "failed" if error else "completed", error, count, *[None] * 13)])

    distinct = targets.select(F.btrim(F.col("target")).alias("target")).where("target <> ''").distinct()
    # A target takes long, so every core gets its share of them; the number of partitions grows with the list.
    return distinct.repartition(4 * spark.sparkContext.defaultParallelism).mapInArrow(run, ROWS)


def outcomes(rows: DataFrame) -> DataFrame:
    """(target, status, error, findings) of the targets."""
    return rows.where(F.col("status").isNotNull()).select("target", "status", "error", "findings")


def found(rows: DataFrame) -> DataFrame:
    """The distinct findings of all targets, as ``scan.of_sources`` gives them, with their target."""
    own = rows.where(F.col("status").isNull()).drop("status", "error", "findings", "view", "start")
    return own.dropDuplicates(["target", "fingerprint"])
