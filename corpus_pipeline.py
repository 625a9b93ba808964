"""A training-data pipeline over ``documents``: five stages, each one operator of leakloom.llm.

Toxic documents go, then those that the quality rules reject, then near copies but one of each group;
secrets are masked, and what is left is packed. Every stage's result is a Parquet table in the shared
folder, which the next one reads, so a lost executor costs the tasks of one stage.

Defined cases: a null or empty text, as any of fewer than ten words, fails the quality rules; rows with a null id are
classes of their own, so none of them is a copy, and rows that repeat an id are one document to the near-duplicates,
which stay or go together; without labels of both classes nothing is toxic and the base rule alone judges quality; further
columns, whatever their names, stay up to packing; an empty table gives no pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakloom.llm import minhash, packing, quality, secrets, toxicity
from leakloom.llm.common import crc_mod, shared_path


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    fitted = toxicity.train(docs, _labels(spark, sf_dir), crc_mod("doc_id", 4) == 2)
    return toxicity.score(docs, fitted, keep=True)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, quality.train(docs, _labels(spark, sf_dir)))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.deduplicate(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return pieces.select("doc_id", "start", "length", "ids", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


STAGES = [("toxicity", drop_toxic), ("quality rules", drop_poor), ("near-duplicates", drop_copies), ("secrets", mask_secrets), ("packing", pack)]
#: Learned models, hashing and a tokenizer: no SQL; tests hold the result against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents that the stages keep."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_path(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
