"""Batch and streaming readers with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell import constants as C
from tracewell import schemas
from tracewell.functions.columns import hashed_unit, step_time
from tracewell.session import use_utc


def _read(spark: SparkSession, path: str, fmt: str, schema: T.StructType) -> DataFrame:
    use_utc(spark)
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)


def read_access(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Access log. Unparsable times become NULL; a hash of the row serves as tie-break id."""
    df = _read(spark, path, fmt, schemas.ACCESS)
    return df.select(F.xxhash64(*df.columns).alias("event_id"), *df.columns)


def read_transactions(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _read(spark, path, fmt, schemas.TRANSACTIONS)


def unreadable(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Rows whose event time could not be parsed, for quarantine."""
    return df.where(F.col(ts).isNull())


def read_ledger(spark: SparkSession, path: str, types: list[str] | None = None, limit: int | None = None,
                fraction: float | None = None, seed: int = 42, fmt: str = "csv") -> DataFrame:
    """Typed ledger. ``limit`` keeps the first rows in the order of the files, before the type filter, as a row limit on load does."""
    df = _read(spark, path, fmt, schemas.LEDGER_RAW)
    if limit is not None:
        placed = df.withColumns({"_f": F.col("_metadata.file_path"), "_b": F.col("_metadata.file_block_start"), "_r": F.monotonically_increasing_id()})
        df = placed.orderBy("_f", "_b", "_r").limit(limit).drop("_f", "_b", "_r")
    if types:
        df = df.where(F.col("type").isin(types))
    if fraction is not None and 0.0 < fraction < 1.0:
        df = df.sample(fraction=fraction, seed=seed)
    return shape_ledger(df)


def shape_ledger(raw: DataFrame) -> DataFrame:
    """Steps to instants, party columns renamed, kept columns only."""
    return raw.select(
        F.xxhash64(*raw.columns).alias("txn_key"),
        F.col("nameOrig").alias("account_id"), "amount", "type", F.col("nameDest").alias("counterparty_id"),
        step_time("step").alias("timestamp"), "step",
        F.col("oldbalanceOrg").alias("oldbalanceorg"), F.col("newbalanceOrig").alias("newbalanceorg"),
        F.col("oldbalanceDest").alias("oldbalancedest"), F.col("newbalanceDest").alias("newbalancedest"),
        F.col("isFraud").alias("isfraud"))


def scored_types(df: DataFrame, col: str = "type", types: list[str] | None = None) -> DataFrame:
    """Rows of the channels that are scored (TRANSFER and CASH_OUT)."""
    return df.where(F.col(col).isin(types or C.SCORED_TYPES))


def sample_rows(df: DataFrame, fraction: float, seed: int = 42, key: str | None = None) -> DataFrame:
    """Seeded Bernoulli sample; the sampling operator itself. With a ``key`` the same rows are drawn however the table is laid out."""
    if key is None:
        return df.sample(fraction=fraction, seed=seed)
    return df.where(hashed_unit(F.lit(seed), F.col(key)) < fraction)


def read_event_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json",
                      max_files: int | None = None, glob: str | None = None) -> DataFrame:
    """File stream of one topic; times must be in a zoned column before a watermark is set."""
    use_utc(spark)
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def read_kafka(spark: SparkSession, servers: str, topics: list[str], starting: str = "latest",
               max_offsets: int | None = None) -> DataFrame:
    """Broker stream of raw values; needs the Kafka connector package on the class path."""
    reader = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
              .option("subscribe", ",".join(topics)).option("startingOffsets", starting))
    if max_offsets:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    return reader.load()


def decode(df: DataFrame, schema: T.StructType, value: Column | str = "value") -> DataFrame:
    """JSON payloads to typed columns."""
    value = F.col(value) if isinstance(value, str) else value
    return df.select(F.from_json(value.cast("string"), schema).alias("e")).select("e.*")
