"""Training documents out of raw ones: quality rules, near duplicates, benchmark passages, target weights, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import decontaminate as decontamination
from tracewell.llm import jaccard_join, mixing, quality_rules, sharding
from tracewell.llm.queries import MIX_WEIGHTS, mix_levels
from tracewell.session import fresh_dir, remove_dir

ORACLE_SQL = None  # the rules' model and the shuffle's draws can't be said in SQL
SHARDS = 24


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard_join.keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the target proportions; one that several epochs take stands there as often."""
    return mixing.mix(docs, mix_levels(), MIX_WEIGHTS).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and slot."""
    return sharding.shuffle_into_shards(docs, SHARDS)


STAGES = [("quality rules", keep_good), ("n-gram Jaccard join", keep_one_of_each), ("benchmark decontamination", decontaminate),
          ("mixing to target weights", mix), ("sharding", shard)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages; each one's documents are written to the shared folder and read again for the next, and go once that is
    written: a stage works on what is stored, never on what the stage before was made of."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        folder = fresh_dir(spark, f"pipeline-{k}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if before:
            remove_dir(spark, before)
        before = folder
    return docs
