"""The states of a job's targets as a log of transitions in a folder, which any number of drivers and tasks append to.

An append is one file, written under a hidden name and moved to its own when it is whole: it is there or it is not, and no
writer touches another's. Each transition has an id, so a row that is read twice counts once. ``compact`` writes all rows as
one snapshot and names the files that it holds; these are deleted by a later compaction, ``grace`` seconds after, so
whoever listed them still finds them. A compaction that is lost on the way, or that runs beside another, leaves
rows twice at most. A snapshot names only files that were there before it, so no two name each other and none is lost.
"""

from __future__ import annotations

import contextlib
import json
import time
import uuid
from collections.abc import Iterable

from pyarrow.fs import FileSelector, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.state import latest
from . import stores, tables

SCHEMA = "id string, job string, target string, status string, error string, at long"
GRACE = 3600.0


def append(folder: str, job: str, rows: Iterable[tuple[str, str, str | None, int | None]]) -> int:
    """Adds transitions (target, status, error, at in nanoseconds or None for now), all or none of them; nothing for no rows."""
    name, now = f"t-{time.time_ns():020d}-{uuid.uuid4().hex}", time.time_ns()
    lines = [json.dumps({"id": f"{name}/{k}", "job": job, "target": t, "status": s, "error": e, "at": now if at is None else at}) + "\n" for k, (t, s, e, at) in enumerate(rows)]
    if lines:
        _place(folder, f"{name}.json", (x.encode() for x in lines))
    return len(lines)


def append_frame(rows: DataFrame, folder: str, job: str) -> DataFrame:
    """(written): each task appends its transitions (target, status, error, at) as one file.

    The file's name is that of the partition in this append, so a task that runs again replaces what it wrote.
    """
    import pandas as pd
    from pyspark import TaskContext

    run = f"t-{time.time_ns():020d}-{uuid.uuid4().hex}"

    def write(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        name, count = f"{run}-{TaskContext.get().partitionId():06d}", 0

        def lines() -> Iterable[bytes]:
            nonlocal count
            for batch in batches:
                for t, s, e, at in batch.itertuples(index=False, name=None):
                    yield (json.dumps({"id": f"{name}/{count}", "job": job, "target": t, "status": s, "error": None if pd.isna(e) else e, "at": int(at)}) + "\n").encode()
                    count += 1

        _place(folder, f"{name}.json", lines())
        yield pd.DataFrame({"written": [count]})

    return rows.select("target", "status", "error", "at").mapInPandas(write, "written long")


def _place(folder: str, name: str, blocks: Iterable[bytes]) -> None:
    draft = f".{name}-{uuid.uuid4().hex}"
    stores.write(f"{folder.rstrip('/')}/{draft}", blocks)
    store, base = stores.of(folder.rstrip("/"))
    store.move(f"{base}/{draft}", f"{base}/{name}")


def _names(folder: str) -> list[str]:
    store, base = stores.of(folder.rstrip("/"))
    return sorted(f.base_name for f in store.get_file_info(FileSelector(base, allow_not_found=True)) if f.type == FileType.File)


def transitions(spark: SparkSession, folder: str, job: str | None = None) -> DataFrame:
    """(job, target, status, error, at) of the log, of one job where it is given; an empty or absent log has none."""
    return _distinct(spark, folder, [n for n in _names(folder) if n[0] in "ts"]).where(F.lit(True) if job is None else F.col("job") == job).drop("id")


def _distinct(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    if not names:
        return spark.createDataFrame([], SCHEMA)
    # A list of files, not the folder: what is moved in between belongs to the next reading.
    return spark.read.schema(SCHEMA).json([f"{folder.rstrip('/')}/{n}" for n in names]).dropDuplicates(["id"])


def states(spark: SparkSession, folder: str, job: str) -> DataFrame:
    """(target, status, attempts, error, at): the last state of each of the job's targets."""
    return latest(transitions(spark, folder, job))


def read(spark: SparkSession, folder: str, job: str) -> dict[str, dict]:
    """The states by target, as the command line keeps them; a job that the log doesn't have is an error."""
    own = {r["target"]: {"status": r["status"], "attempts": r["attempts"], "error": r["error"] or ""} for r in states(spark, folder, job).toLocalIterator()}
    if not own:
        raise ValueError(f"{folder} has no job {job}")
    return own


def compact(spark: SparkSession, folder: str, grace: float = GRACE, now: float | None = None) -> int:
    """Writes the log as one snapshot, deletes what snapshots have held for ``grace`` seconds, and gives the number of files that it holds.

    The rows pass the driver as blocks of bytes. ``grace`` must be longer than any reading or compaction takes.
    """
    store, base = stores.of(folder.rstrip("/"))
    names, now = _names(folder), time.time() if now is None else now
    for mark in [n for n in names if n.startswith("_holds-")]:
        try:
            with store.open_input_stream(f"{base}/{mark}") as f:
                held = json.loads(f.read())
        except FileNotFoundError:  # another compaction was first
            names.remove(mark)
            continue
        if held["snapshot"] in names and held["at"] + grace <= now:
            for gone in [n for n in (*held["files"], mark) if n in names]:
                names.remove(gone)
                with contextlib.suppress(FileNotFoundError):  # another compaction was first
                    store.delete_file(f"{base}/{gone}")
    files = [n for n in names if n[0] in "ts"]
    if len(files) < 2:
        return 0
    parts = tables.fresh(spark, "joblog")
    _distinct(spark, folder, files).select(F.to_json(F.struct("*")).alias("value")).write.text(parts)
    snapshot = f"s-{time.time_ns():020d}-{uuid.uuid4().hex}.json"
    _place(folder, snapshot, stores.blocks(parts))
    _place(folder, f"_holds-{snapshot}", [json.dumps({"snapshot": snapshot, "at": now, "files": files}).encode()])
    return len(files)
