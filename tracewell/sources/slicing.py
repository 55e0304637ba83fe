"""Scenario slices, the interleaved event stream and the scenario catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell import constants as C
from tracewell import schemas
from tracewell.functions.columns import gap_seconds
from tracewell.operators.ordering import previous_value

_CATALOGUE_COLUMNS = ["scenario_id", "title", "description", "expected_events", "recommended_speed"]


def scenario_slice(access: DataFrame, txns: DataFrame, scenario: str | None, pad: str = "2 hours") -> tuple[DataFrame, DataFrame]:
    """Transactions of one scenario, and the accesses to their accounts inside the slice's padded time span.

    With no transactions in the slice the accesses stay unfiltered, as do both tables for ``all``.
    """
    if not scenario or scenario.lower() == "all":
        return access, txns
    chosen = txns.where(F.lower("scenario") == scenario.lower())
    bounds = chosen.agg(F.struct(
        (F.min("timestamp") - F.expr(f"interval {pad}")).alias("lo"),
        (F.max("timestamp") + F.expr(f"interval {pad}")).alias("hi")).alias("b"))
    accounts = chosen.select("account_id").distinct().withColumn("_hit", F.lit(True))
    tagged = access.join(accounts, "account_id", "left").withColumn("_b", bounds.scalar())
    inside = F.col("_hit") & F.col("timestamp").between(F.col("_b.lo"), F.col("_b.hi"))
    kept = tagged.where(F.col("_b.lo").isNull() | F.coalesce(inside, F.lit(False)))
    return kept.select(*access.columns), chosen


def interleave(access: DataFrame, txns: DataFrame) -> DataFrame:
    """Both tables as one tagged JSON stream; an access precedes a transaction of the same instant."""
    payload = lambda schema: F.to_json(F.struct(*[
        (F.col(f.name).cast("string") if f.name == "timestamp" else F.col(f.name)).alias(f.name) for f in schema.fields]))
    left = access.select("timestamp", F.lit("access_events").alias("topic"), F.lit(0).alias("topic_rank"),
                         F.col("event_id").cast("string").alias("event_key"), "account_id",
                         payload(schemas.ACCESS).alias("payload"))
    right = txns.select("timestamp", F.lit("transactions").alias("topic"), F.lit(1).alias("topic_rank"),
                        F.col("transaction_id").alias("event_key"), "account_id",
                        payload(schemas.TRANSACTIONS).alias("payload"))
    return left.unionByName(right)


STREAM_ORDER = ["timestamp", "topic_rank", "event_key"]


def replay_gaps(stream: DataFrame, speed: float = 500.0, lo: float = 0.001, hi: float = 0.15) -> DataFrame:
    """Time-compressed delay before each event, held between ``lo`` and ``hi`` seconds; none before the first."""
    with_prev = previous_value(stream, STREAM_ORDER, "timestamp", "_prev")
    delta = F.greatest(F.lit(0.0), gap_seconds("_prev", "timestamp"))
    out = with_prev.withColumn("gap_seconds", F.when(F.col("_prev").isNotNull(), delta))
    delay = F.least(F.lit(hi), F.greatest(F.lit(lo), F.col("gap_seconds") / F.lit(speed)))
    return out.withColumn("delay_seconds", F.when(F.col("gap_seconds").isNotNull(), delay)).drop("_prev")


def scenario_catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(C.SCENARIOS, _CATALOGUE_COLUMNS)


def get_scenario(spark: SparkSession, scenario: str) -> DataFrame:
    """Catalogue row of one scenario; unknown names are an error, ``all`` is the whole timeline."""
    wanted = scenario.lower()
    if wanted == "all":
        return spark.createDataFrame([("all", "Full Timeline Stream", 500.0)],
                                     "scenario_id string, title string, recommended_speed double")
    if wanted not in {row[0] for row in C.SCENARIOS}:
        raise ValueError(f"unknown scenario {scenario!r}")
    return scenario_catalogue(spark).where(F.col("scenario_id") == wanted)


def scenario_counts(access: DataFrame, txns: DataFrame) -> DataFrame:
    """Transactions found per catalogued scenario beside the catalogue's expected events."""
    found = txns.groupBy(F.lower("scenario").alias("scenario_id")).agg(F.count(F.lit(1)).alias("found_events"))
    return (scenario_catalogue(txns.sparkSession).join(found, "scenario_id", "left")
            .select("scenario_id", "title", "expected_events", "recommended_speed",
                    F.coalesce("found_events", F.lit(0)).alias("found_events")))
