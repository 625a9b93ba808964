"""An index of accepted fingerprints, for baselines too large to shuffle with every scan.

``write`` keeps them as a table that is bucketed and sorted by fingerprint, which a join reads as it lies, and as blocks of
bits (a Bloom filter of 4 KB blocks, a block for some 3200 fingerprints, four bits each; 1 to 2 % of other
fingerprints pass). ``without`` asks the blocks first: a finding that is in none is new and goes on without a
shuffle; the others alone are shuffled to the buckets. The blocks are broadcast while their size, which the index states, is within
``max_broadcast``; an index beyond that has its findings all shuffled to the buckets, and itself still isn't.

Repeated and empty fingerprints and nulls are left out of the index; findings without a fingerprint are never accepted.
"""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import stores, tables

BITS, HASHES, PER_BLOCK = 32768, 4, 3200
#: Fingerprints of a bucket, some 64 bytes each.
PER_BUCKET = 2_000_000


@dataclass(frozen=True)
class Index:
    folder: str
    count: int
    buckets: int
    blocks: int

    @property
    def filter_bytes(self) -> int:
        return self.blocks * BITS // 8


def _hash(fingerprint: Column, seed: int) -> Column:
    return F.xxhash64(fingerprint, F.lit(seed))


def _block(fingerprint: Column, blocks: int) -> Column:
    return F.pmod(_hash(fingerprint, 0), F.lit(blocks))


def _places(fingerprint: Column) -> list[Column]:
    return [F.pmod(_hash(fingerprint, k + 1), F.lit(BITS)) for k in range(HASHES)]


def write(accepted: DataFrame, folder: str, buckets: int | None = None) -> Index:
    """The index of the fingerprints (fingerprint) at a new folder that all executors reach."""
    spark, folder = accepted.sparkSession, folder.rstrip("/")
    own = tables.written(accepted.select("fingerprint").where("fingerprint <> ''").distinct(), "accepted")
    count = own.count()
    index = Index(folder, count, buckets or max(1, math.ceil(count / PER_BUCKET)), max(1, math.ceil(count / PER_BLOCK)))
    name = f"leakloom_{hashlib.sha256(folder.encode()).hexdigest()[:24]}_new"
    rows = own.repartition(index.buckets, "fingerprint")
    rows.write.bucketBy(index.buckets, "fingerprint").sortBy("fingerprint").option("path", f"{folder}/table").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay; ``load`` names them in whatever catalog a session has
    fingerprint = F.col("fingerprint")
    bits = own.select(_block(fingerprint, index.blocks).alias("block"), F.explode(F.array(*_places(fingerprint))).alias("place"))
    bits.groupBy("block").agg(F.bitmap_construct_agg("place").alias("bits")).write.parquet(f"{folder}/filter")
    stores.write(f"{folder}/index.json", [json.dumps({k: v for k, v in asdict(index).items() if k != "folder"}).encode()])
    return index


def load(folder: str) -> Index:
    store, name = stores.of(folder.rstrip("/"))
    with store.open_input_stream(f"{name}/index.json") as f:
        return Index(folder.rstrip("/"), **json.loads(f.read()))


def table(spark: SparkSession, index: Index) -> DataFrame:
    """The fingerprints (accepted), bucketed; the session's catalog gets a table that only points to the files."""
    name = f"leakloom_{hashlib.sha256(index.folder.encode()).hexdigest()[:24]}"
    place = index.folder.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (fingerprint STRING) USING parquet CLUSTERED BY (fingerprint) SORTED BY (fingerprint) INTO {index.buckets} BUCKETS LOCATION '{place}/table'")
    return spark.table(name).select(F.col("fingerprint").alias("accepted"))


def asked(found: DataFrame, index: Index) -> DataFrame:
    """``found`` with ``__may``: whether the blocks may have the fingerprint. Nothing is shuffled."""
    fingerprint = F.col("fingerprint")
    bit = lambda place: F.conv(F.hex(F.substring("__bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int").bitwiseAND(F.pow(F.lit(2), place % 8).cast("int")) != 0
    every = F.lit(True)
    for place in _places(fingerprint):
        every = every & bit(place)
    blocks = found.sparkSession.read.parquet(f"{index.folder}/filter").select(F.col("block").alias("__block"), F.col("bits").alias("__bits"))
    rows = found.join(F.broadcast(blocks), _block(fingerprint, index.blocks) == F.col("__block"), "left")
    return rows.select(*[F.col(f"`{c}`") for c in found.columns], F.coalesce(every, F.lit(False)).alias("__may"))


def without(found: DataFrame, index: Index, max_broadcast: int = 256 << 20) -> DataFrame:
    """Findings whose fingerprint isn't in the index."""
    accepted = table(found.sparkSession, index)
    if index.filter_bytes > max_broadcast:
        return found.join(accepted, F.col("fingerprint") == F.col("accepted"), "left_anti")
    # Taken twice, for those that are new and those that may not be, so it is written once.
    rows = tables.written(asked(found, index), "asked")
    may = rows.where("__may").join(accepted, F.col("fingerprint") == F.col("accepted"), "left_anti")
    return rows.where("NOT __may").unionByName(may).drop("__may")
