"""Baselines, job states, roll-ups and catalog parity, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATUSES = ("pending", "running", "completed", "failed")


def without_baseline(found: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings whose fingerprint isn't accepted; Spark broadcasts the baseline only while it is small."""
    return found.join(baseline.select("fingerprint").where("fingerprint <> ''").distinct(), "fingerprint", "left_anti").select(found.columns)


def baseline_of(found: DataFrame) -> DataFrame:
    """Distinct non-empty fingerprints, sorted."""
    return found.select("fingerprint").where("fingerprint <> ''").distinct().orderBy("fingerprint")


def latest(transitions: DataFrame) -> DataFrame:
    """(target, status, attempts, error, at) from transitions (target, status, error, at): the last one, and how often it ran."""
    last = F.max_by(F.struct("status", "error"), F.struct("at", "status"))
    return transitions.groupBy("target").agg(last.alias("last"), F.count_if(F.col("status") == "running").alias("attempts"), F.max("at").alias("at")).select("target", "last.status", "attempts", "last.error", "at")


def to_resume(targets: DataFrame, state: DataFrame) -> DataFrame:
    """Targets that aren't completed; unknown ones count as pending."""
    return targets.join(state.select("target", "status"), "target", "left").where(F.coalesce("status", F.lit("pending")) != "completed").select("target")


def to_retry(targets: DataFrame, state: DataFrame) -> DataFrame:
    return targets.join(state.where("status = 'failed'").select("target"), "target", "left_semi")


def unseen(targets: DataFrame, state: DataFrame) -> DataFrame:
    return targets.join(state.select("target"), "target", "left_anti")


def status_counts(state: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """(status, targets); of ``targets``, where given, those that no transition names are pending."""
    rows = state.select("target", "status")
    if targets is not None:
        rows = targets.select("target").distinct().join(rows, "target", "left")
    known = F.when(F.col("status").isin(*STATUSES), F.col("status")).otherwise("pending")
    return rows.groupBy(known.alias("status")).agg(F.count("*").alias("targets"))


def by_owner(repositories: DataFrame) -> DataFrame:
    """Repositories per owner of ``full_name``."""
    return repositories.groupBy(F.substring_index("full_name", "/", 1).alias("owner")).agg(F.count("*").alias("repositories"))


def by_organisation(repositories: DataFrame, found: DataFrame) -> DataFrame:
    """Repositories and findings per organisation; those with findings only are added."""
    repos = repositories.groupBy("org").agg(F.count("*").alias("repositories"))
    secrets = found.groupBy("org").agg(F.count("*").alias("findings"))
    return repos.join(secrets, "org", "full_outer").select("org", F.coalesce("repositories", F.lit(0)).alias("repositories"), F.coalesce("findings", F.lit(0)).alias("findings"))


def last_by_name(repositories: DataFrame, order: str) -> DataFrame:
    """One row per full_name, the last in ``order``; blank names go; sorted."""
    rows = repositories.where(F.trim("full_name") != "")
    picked = rows.groupBy("full_name").agg(F.max_by(F.struct(*rows.columns), order).alias("r"))
    return picked.select("r.*").orderBy("full_name")


def by_installation(installations: DataFrame, repositories: DataFrame) -> DataFrame:
    """(installation, account, repositories): repositories of each installation's account, whatever the case of names."""
    counts = repositories.groupBy(F.lower("account").alias("__account")).agg(F.count("*").alias("repositories"))
    joined = installations.join(counts, F.lower("account") == F.col("__account"), "left")
    return joined.select("installation", "account", F.coalesce("repositories", F.lit(0)).alias("repositories"))


def with_token(targets: DataFrame, installations: DataFrame) -> DataFrame:
    """Targets (target, owner) with the installation whose account owns them, whatever the case; null where none does."""
    own = installations.groupBy(F.lower("account").alias("__account")).agg(F.min("installation").alias("installation"))
    return targets.join(own, F.lower("owner") == F.col("__account"), "left").select("target", "owner", "installation")


def outcomes(state: DataFrame) -> DataFrame:
    """One row: how many targets succeeded and failed, and the failures (target, error), sorted."""
    failed = F.col("status") == "failed"
    listed = F.array_sort(F.collect_list(F.when(failed, F.struct("target", F.coalesce("error", F.lit("")).alias("error")))))
    return state.agg(F.count_if(F.col("status") == "completed").alias("succeeded"), F.count_if(failed).alias("failed"), listed.alias("failures"))


def totals(found: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """One row: findings before the baseline's are left out, and after."""
    if baseline is None:
        return found.agg(F.count("*").alias("before"), F.count("*").alias("after"))
    known = baseline.select("fingerprint").where("fingerprint <> ''").distinct().withColumn("__known", F.lit(True))
    rows = found.select("fingerprint").join(known, "fingerprint", "left")
    return rows.agg(F.count("*").alias("before"), F.count_if(F.col("__known").isNull()).alias("after"))


def at_every_place(objects: DataFrame, places: DataFrame) -> DataFrame:
    """Findings of objects (oid) at each (commit, path) that has the object."""
    return objects.join(places, "oid")


def parity_counts(mappings: DataFrame) -> DataFrame:
    return mappings.groupBy("status").agg(F.count("*").alias("mappings"), F.countDistinct("catalog_id").alias("catalog_ids"), F.countDistinct("detector_id").alias("detectors"))


def parity_duplicates(mappings: DataFrame) -> DataFrame:
    return mappings.groupBy("catalog_id").agg(F.count("*").alias("mappings")).where("mappings > 1")


def parity_known(registry: DataFrame, mappings: DataFrame) -> DataFrame:
    """Mappings whose detector exists."""
    return mappings.join(registry.select("detector_id"), "detector_id", "left_semi")


def parity_outside(catalog: DataFrame, mappings: DataFrame) -> DataFrame:
    """Mappings of ids that the catalog doesn't have."""
    return mappings.join(catalog.select("catalog_id"), "catalog_id", "left_anti")


def parity_untracked(registry: DataFrame, mappings: DataFrame) -> DataFrame:
    """Detectors that no catalog entry is mapped to."""
    return registry.select("detector_id").join(mappings.select("detector_id"), "detector_id", "left_anti")


def within_budget(entries: DataFrame, max_entries: int, max_bytes: int, max_entry: int) -> DataFrame:
    """Archive entries (archive, idx, size) up to the first that breaks a budget of their archive.

    Oversize entries are left out first; an entry that goes beyond the bytes ends its archive.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("archive").orderBy("idx", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = entries.where(F.col("size") <= max_entry).withColumn("total", F.sum("size").over(w)).withColumn("place", F.count("*").over(w))
    return rows.where((F.col("total") <= max_bytes) & (F.col("place") <= max_entries))
