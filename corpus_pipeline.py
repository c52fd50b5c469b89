"""The corpus pipeline: quality rules, exact and near copies, source mix, packing.

Every stage takes the documents that the stage before kept and returns documents; the last
returns the pieces of the packed sequences. What a stage writes for itself to the shared folder stays until the
caller deletes it; ``run`` deletes what its own stages have left as soon as their results are written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovetable.llm import exact, mixing, near, packing, quality
from grovetable.llm.common import owning, remove_path, scratch_root


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids", "source_queue", "queue_start", "round")


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: Tokenizing, fingerprints and components are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{scratch_root(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        with owning() as left:
            stage(spark, docs, sf_dir).write.parquet(path)
        for scratch in left:
            remove_path(spark, scratch)
        docs = spark.read.parquet(path)
    return docs
