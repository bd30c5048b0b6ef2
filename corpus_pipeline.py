"""A corpus pipeline over the documents table: each stage's result is written and reread as the next one's input.

Rejected documents go, one document of each near-duplicate group stays, contaminated documents go, sources are
mixed to their target weights (documents in as many rows as the mix takes them), and the rows are sharded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import read, shared_table, small_batches
from tidewater.llm.decontaminate import decontaminate
from tidewater.llm.mixing import mix_documents
from tidewater.llm.near_dedup import dedup_near
from tidewater.llm.quality import keep_good
from tidewater.llm.sharding import shard_documents


@small_batches
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold."""
    return keep_good(docs, read(spark, sf_dir, "labels"))


@small_batches
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return dedup_near(docs)


@small_batches
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


@small_batches
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: whole copies, and the stretches of chosen blocks; n_chars follows the text."""
    mixed = mix_documents(docs)
    if "n_chars" not in docs.columns:
        return mixed
    return mixed.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


@small_batches
def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with shard and slot."""
    return shard_documents(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination),
          ("mixing", mixing), ("sharding", sharding)]

# The classifier's and the sampling stages' decisions have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of ``sf_dir``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
