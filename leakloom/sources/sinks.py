"""Outputs: JSON, JSON lines, SARIF, text, baselines and state files."""

from __future__ import annotations

import json
import os
import re
import tempfile
import time
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.findings import sarif_level
from . import stores, tables
from .hosting import is_remote, owner

FIELDS = ("detector_id", "name", "severity", "file", "commit", "line", "column", "secret", "redacted", "verified", "fingerprint")
FORMATS = ("json", "jsonl", "sarif", "human")
EXTENSIONS = {"json": "json", "jsonl": "jsonl", "sarif": "sarif", "human": "txt"}


def shown(found: DataFrame, raw: bool = False) -> DataFrame:
    """Findings as they are written: the secret only where raw values are asked for."""
    return found.select(*FIELDS) if raw else found.withColumn("secret", F.lit("")).select(*FIELDS)


def check_format(name: str) -> str:
    if name not in FORMATS:
        raise ValueError(f"unknown format {name}; one of {', '.join(FORMATS)}")
    return name


def sarif_rules(found: DataFrame) -> DataFrame:
    return found.groupBy("detector_id").agg(F.min("name").alias("name"))


def sarif_results(found: DataFrame) -> DataFrame:
    return found.select(F.col("detector_id").alias("rule_id"), sarif_level(F.col("severity")).alias("level"), F.concat("name", F.lit(" "), "redacted").alias("message"), F.col("file").alias("uri"), F.col("line").alias("start_line"), F.col("column").alias("start_column"), "fingerprint")


def _report_lines(found: DataFrame, how: str, raw: bool) -> DataFrame:
    """A line (``value``) for each finding; in a list of JSON each begins with the comma that parts it from the one before."""
    if how == "human":
        return human_lines(found, raw).select(F.replace("value", F.lit("\n"), F.lit("\\n")).alias("value"))
    if how == "sarif":
        place = F.struct(F.struct(F.col("uri")).alias("artifactLocation"), F.struct(F.col("start_line").alias("startLine"), F.col("start_column").alias("startColumn")).alias("region"))
        shape = F.struct(F.col("rule_id").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"), F.array(F.struct(place.alias("physicalLocation"))).alias("locations"))
        return sarif_results(found).select(F.concat(F.lit(","), F.to_json(shape)).alias("value"))
    text = lambda names: F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    line = F.when(F.coalesce("commit", F.lit("")) == "", text([f for f in FIELDS if f != "commit"])).otherwise(text(FIELDS))
    return shown(found, raw).select(F.concat(F.lit("," if how == "json" else ""), line).alias("value"))


def report(found: DataFrame, how: str, meta: dict | None = None, raw: bool = False) -> Iterator[bytes]:
    """A report in blocks of bytes. Tasks write its lines as numbered parts to the shared folder; the driver copies them in order, a block at a time.

    Findings keep the order of their rows, but in SARIF, whose results are read from a table again.
    """
    check_format(how)
    spark = found.sparkSession
    head, tail = b"", b""
    if how == "json":
        head, tail = f'{{"meta": {json.dumps(meta or {})}, "findings": [\n'.encode(), b"]}\n"
    elif how == "sarif":
        # Used twice, for the results and for their rules, so it is written once.
        found = tables.written(found.select("detector_id", "name", "severity", "file", "line", "column", "redacted", "fingerprint"), "findings")
        rules = [{"id": r["detector_id"], "name": r["name"], "shortDescription": {"text": r["name"]}} for r in sarif_rules(found).orderBy("detector_id").toLocalIterator()]
        tool = json.dumps({"driver": {"name": "leakloom", "rules": rules}})
        head, tail = f'{{"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{{"tool": {tool}, "results": [\n'.encode(), b"]}]}\n"
    folder = tables.fresh(spark, "report")
    _report_lines(found, how, raw).write.option("lineSep", "\n").text(folder)
    yield head
    count, first = 0, how in ("json", "sarif")
    for block in stores.blocks(folder):
        count += block.count(b"\n")
        yield block[1:] if first else block
        first = False
    yield f"{count} findings\n".encode() if how == "human" else tail


def render(found: DataFrame, how: str, meta: dict | None = None, raw: bool = False) -> Iterator[str]:
    """The lines of a report."""
    rest = b""
    for block in report(found, how, meta, raw):
        *lines, rest = (rest + block).split(b"\n")
        yield from (x.decode() for x in lines)


def write_lines(found: DataFrame, path: str, raw: bool = False, mode: str = "overwrite") -> None:
    """JSON lines by Spark's writer, a file per task."""
    shown(found, raw).write.mode(mode).json(path)


def json_lines(found: DataFrame, raw: bool = False) -> DataFrame:
    """Findings as JSON lines in one column; an empty commit is left out."""
    rows = shown(found, raw).withColumn("commit", F.nullif("commit", F.lit("")))
    return rows.select(F.to_json(F.struct(*FIELDS)).alias("value"))


def human_lines(found: DataFrame, raw: bool = False) -> DataFrame:
    """Findings as lines of text in one column."""
    secret = F.col("secret") if raw else F.col("redacted")
    return found.select(F.format_string("[%s] %s %s:%d:%d %s", "severity", "name", "file", "line", "column", secret).alias("value"))


class LineWriter:
    """Appends findings to a JSON lines file as they come, made durable after every ``every`` rows and at the end."""

    def __init__(self, path: str, every: int = 25, raw: bool = False, mode: str = "overwrite") -> None:
        self.file = open(path, "a" if mode == "append" else "w", encoding="utf-8")
        self.every, self.raw, self.count = max(1, every), raw, 0

    def write(self, found: DataFrame) -> int:
        before = self.count
        for line in render(found, "jsonl", raw=self.raw):
            self.file.write(line + "\n")
            self.count += 1
            if self.count % self.every == 0:
                self.flush()
        self.flush()
        return self.count - before

    def flush(self) -> None:
        self.file.flush()
        os.fsync(self.file.fileno())

    def close(self) -> None:
        self.flush()
        self.file.close()


def summary(state: dict[str, dict], discovery: dict | None = None, before: int = 0, after: int = 0, known: list[str] = ()) -> dict:
    """What a scan did: discovery, targets by outcome, the failures, findings before and after the baseline."""
    by = lambda s: sorted(t for t, x in state.items() if x.get("status") == s)
    own = [*state, *(t for t in known if t not in state)]
    return {
        "discovery": discovery or {},
        "targets": {"total": len(own), "completed": len(by("completed")), "failed": len(by("failed")), "running": len(by("running")), "pending": len(own) - len(by("completed")) - len(by("failed")) - len(by("running"))},
        "failures": [{"target": t, "error": state[t].get("error", "")} for t in by("failed")],
        "findings": {"before_baseline": before, "after_baseline": after},
    }


def default_path(how: str, folder: str = ".") -> str:
    return str(Path(folder) / f"findings.{EXTENSIONS[check_format(how)]}")


def resume_path(path: str, how: str, now: float | None = None, kind: str = "jsonl") -> tuple[str, str]:
    """(path, mode) of a resumed output: append, overwrite, or a new name with the time."""
    if how == "append" and kind != "jsonl":
        raise ValueError("only JSON lines can be appended to")
    if how in ("append", "overwrite"):
        return path, how
    if how != "new":
        raise ValueError("a resumed output is appended, overwritten or new")
    p = Path(path)
    stamp = time.strftime("%Y%m%dT%H%M%SZ", time.gmtime(now))
    return str(p.with_name(f"{p.stem}.resume-{stamp}{p.suffix}")), "overwrite"


def write_private(path: str | os.PathLike, text: str) -> None:
    """Write a file that only its owner reads, in one step; its folder is made private."""
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True, mode=0o700)
    handle, name = tempfile.mkstemp(dir=p.parent)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(text)
    os.chmod(name, 0o600)
    os.replace(name, p)


def write_baseline(found: DataFrame, path: str) -> None:
    from ..operators.state import baseline_of

    write_private(path, json.dumps({"fingerprints": [r[0] for r in baseline_of(found).toLocalIterator()]}, indent=2) + "\n")


def read_baseline(spark, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True, schema="fingerprints array<string>").select(F.explode("fingerprints").alias("fingerprint"))


def job_scope(target: str = "", repo_list: str = "", orgs: list[str] = (), enterprise: str = "", accessible: bool = False) -> str:
    """What a job's id begins with: the widest of what it scans."""
    if enterprise:
        return f"enterprise-{enterprise}"
    if orgs:
        return "org-" + "-".join(orgs)
    if accessible:
        return "accessible"
    if repo_list:
        return f"repo-list-{Path(repo_list).stem}"
    if is_remote(target):
        return f"repo-{owner(target)}-{Path(target).name.removesuffix('.git')}"
    return f"target-{Path(target).resolve().name}"


def job_id(scope: str, now: float) -> str:
    clean = re.sub(r"[^a-z0-9]+", "-", scope.lower()).strip("-")[:60].strip("-") or "scan"
    return f"{clean}-{time.strftime('%Y%m%dt%H%M%Sz', time.gmtime(now))}"


def write_job(path: str, job: str, targets: dict[str, dict]) -> None:
    write_private(path, json.dumps({"job_id": job, "updated_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "targets": targets}, indent=2))


def read_job(path: str, job: str) -> dict[str, dict]:
    state = json.loads(Path(path).read_text(encoding="utf-8"))
    if state.get("job_id") != job:
        raise ValueError(f"{path} is the state of job {state.get('job_id')}, not {job}")
    return state["targets"]
