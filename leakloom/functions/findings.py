"""Location, redaction, fingerprint and deduplication of findings, as columns."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SARIF_LEVELS = {"critical": "error", "high": "error", "medium": "warning"}


def line(before: Column) -> Column:
    """1-based line of what follows the text ``before``."""
    return (1 + F.octet_length(before) - F.octet_length(F.replace(before, F.lit("\n"), F.lit("")))).cast("int")


def column(before: Column) -> Column:
    """1-based byte column of what follows the text ``before``."""
    return (F.octet_length(F.substring_index(before, "\n", -1)) + 1).cast("int")


def fingerprint(detector: Column, secret: Column, file: Column, commit: Column) -> Column:
    nul = F.lit("\x00")
    return F.sha2(F.concat(detector, nul, secret, nul, file, nul, F.coalesce(commit, F.lit(""))), 256)


def fingerprint_of(detector: str, secret: str, file: str, commit: str) -> str:
    return hashlib.sha256("\x00".join((detector, secret, file, commit)).encode("utf-8", "surrogateescape")).hexdigest()


def redacted(secret: Column) -> Column:
    """Four bytes at either end, stars between; up to eight bytes all stars. Exact for ASCII secrets."""
    n = F.octet_length(secret)
    return F.when(n <= 8, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.substring(secret, 1, 4), F.repeat(F.lit("*"), n - 8), F.substring(secret, -4, 4)))


def redacted_of(secret: str) -> str:
    raw = secret.encode("utf-8", "surrogateescape")
    return ("*" * len(raw) if len(raw) <= 8 else (raw[:4] + b"*" * (len(raw) - 8) + raw[-4:]).decode("utf-8", "replace"))


def sarif_level(severity: Column) -> Column:
    out = F.lit("note")
    for k, v in SARIF_LEVELS.items():
        out = F.when(F.lower(severity) == k, F.lit(v)).otherwise(out)
    return out


def first_in_file(candidates: DataFrame) -> DataFrame:
    """One row per (detector_id, secret, file, commit): the first in raw text, else in decoded text."""
    w = Window.partitionBy("detector_id", "secret", "file", "commit").orderBy("view", "start")
    return candidates.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def distinct(findings: DataFrame) -> DataFrame:
    return findings.dropDuplicates(["fingerprint"])


def reidentify(findings: DataFrame, places: DataFrame) -> DataFrame:
    """Findings of each object (oid) at every (commit, path) that has it; an archive entry's suffix stays."""
    suffix = F.when(F.instr("file", "!/") > 0, F.expr("substring(file, instr(file, '!/'))")).otherwise(F.lit(""))
    joined = findings.withColumn("__suffix", suffix).drop("file", "commit", "fingerprint").join(places.select("oid", "path", F.col("commit").alias("commit")), "oid")
    out = joined.withColumn("file", F.concat("path", "__suffix")).drop("path", "__suffix")
    return out.withColumn("fingerprint", fingerprint(F.col("detector_id"), F.col("secret"), F.col("file"), F.col("commit")))
