"""The detect stage on streams: each micro-batch is scanned as a batch is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.detect import detect
from ..operators.state import without_baseline


def read_files(spark: SparkSession, folder: str, schema: str = "path string, modificationTime timestamp, length long, content binary") -> DataFrame:
    """New files of a folder as sources."""
    rows = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder)
    return rows.select(F.col("path").alias("file"), F.lit("").alias("commit"), "content")


def scan(sources: DataFrame, path: str, checkpoint: str, baseline: DataFrame | None = None, raw: bool = False, available_now: bool = True) -> StreamingQuery:
    """Append new findings as JSON lines; the checkpoint makes a restarted scan go on where it was.

    Fingerprints that were given are kept in the query's keyed state, by its own shuffle partitions, so a batch, or a restarted
    query, gives only what no batch before had. The state grows with the distinct findings, some
    hundred bytes each; with the RocksDB state store it needn't fit in memory. Findings of the baseline never enter it.
    """
    from ..sources.sinks import shown

    found = detect(sources)
    new = (found if baseline is None else without_baseline(found, baseline)).dropDuplicates(["fingerprint"])
    out = shown(new, raw)
    writer = out.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()
