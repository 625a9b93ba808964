"""Whole scans: sources, detection, deduplication, baseline."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from ..functions import findings
from ..operators import accepted
from ..operators.detect import detect, verify
from ..operators.registry import Detector
from ..operators.state import without_baseline
from ..sources import archives, files, git, ranges, tables


def of_sources(sources: DataFrame, detectors: tuple[Detector, ...] | None = None, baseline: DataFrame | accepted.Index | None = None, limits: archives.Limits | None = None, verifiers: dict | None = None) -> DataFrame:
    """Distinct findings: narrow detection, one shuffle by fingerprint, one anti-join."""
    rows = archives.opened(sources, limits) if limits else sources
    found = findings.distinct(detect(rows, detectors).drop("view", "start"))
    return verify(without(found, baseline), verifiers or {})


def without(found: DataFrame, baseline: DataFrame | accepted.Index | None) -> DataFrame:
    """Findings that aren't accepted, by a table of fingerprints or by their index."""
    if isinstance(baseline, accepted.Index):
        return accepted.without(found, baseline)
    return found if baseline is None else without_baseline(found, baseline)


def of_folder(spark: SparkSession, root: str, detectors: tuple[Detector, ...] | None = None, **options) -> DataFrame:
    own = {k: options.pop(k) for k in ("include", "exclude", "max_file") if k in options}
    limits = options.pop("limits", None)
    if limits:
        rows = ranges.read_folder(spark, root, limits, **own)
    else:
        rows = files.read_file(spark, root) if os.path.isfile(root) else files.read_folder(spark, root, **own)
    return of_sources(rows, detectors, **options)


def of_history(spark: SparkSession, repo: str, detectors: tuple[Detector, ...] | None = None, include: list[str] = (), exclude: list[str] = (), limits: archives.Limits | None = None, max_file: int = files.MAX_FILE) -> DataFrame:
    """Findings of every distinct object, at every (commit, path) that has it."""
    from pyspark.sql import functions as F

    allowed = files.allowed(F.col("path"), list(include), list(exclude), bool(limits))
    # Used twice, for the objects and for where they are, so it is written once.
    places = tables.written(git.places(spark, repo).where(allowed), "places")
    rows = git.objects(spark, repo, places, max_file)
    sources = rows.select(F.concat("oid", F.lit("/"), "file").alias("file"), "commit", "content")
    found = detect(archives.opened(sources, limits) if limits else sources, detectors).drop("view", "start")
    found = found.withColumn("oid", F.substring_index("file", "/", 1)).withColumn("file", F.expr("substring(file, instr(file, '/') + 1)"))
    return findings.distinct(findings.reidentify(found, places).select("detector_id", "name", "severity", "file", "commit", "line", "column", "secret", "redacted", "verified", "fingerprint"))
