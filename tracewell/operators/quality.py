"""Checks of the input tables. Each gives counts or a PASS/WARNING row; none raises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell import constants as C
from tracewell.operators.links import prior_access


def _verdict(ok: Column) -> Column:
    return F.when(ok, "PASS").otherwise("WARNING").alias("status")


def unmatched(txns: DataFrame, access: DataFrame, key: str = "account_id") -> DataFrame:
    """Accounts with transactions but without any access."""
    return txns.select(key).distinct().join(access.select(key).distinct(), key, "left_anti")


def unmatched_check(txns: DataFrame, access: DataFrame, key: str = "account_id") -> DataFrame:
    n = unmatched(txns, access, key).agg(F.count(F.lit(1)))
    row = txns.agg(F.countDistinct(key).alias("n_accounts")).withColumn("n_unmatched", n.scalar())
    return row.select("n_accounts", "n_unmatched", _verdict(F.col("n_unmatched") == 0))


def rate_check(df: DataFrame, label: str, lo: float, hi: float) -> DataFrame:
    """Positive share in percent against its allowed range."""
    row = df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(label).cast("long").alias("n_positive"),
                 (F.avg(label) * 100.0).alias("rate_pct"))
    return row.select("*", _verdict(F.col("rate_pct").between(lo, hi)))


def domain_check(df: DataFrame, col: str, allowed: list[str], subset: bool = False) -> DataFrame:
    """Values outside the allowed set; with ``subset`` the allowed values that are absent instead."""
    values = df.select(F.col(col).alias("value")).distinct()
    if not subset:
        return values.where(~F.col("value").isin(allowed))
    wanted = df.sparkSession.createDataFrame([(v,) for v in allowed], "value string")
    return wanted.join(values, "value", "left_anti")


def amount_check(df: DataFrame, col: str = "amount") -> DataFrame:
    row = df.agg(F.count_if(F.col(col) < 0).alias("n_negative"))
    return row.select("n_negative", _verdict(F.col("n_negative") == 0))


def scenario_size_check(txns: DataFrame, scenario: str = "structuring", least: int = 50) -> DataFrame:
    row = txns.agg(F.count_if(F.col("scenario") == scenario).alias("n_rows"))
    return row.select("n_rows", _verdict(F.col("n_rows") >= least))


def prior_access_check(txns: DataFrame, access: DataFrame, within_min: float = C.ASOF_TOLERANCE_MINUTES,
                       scenario: str = "temporal_link") -> DataFrame:
    """Transactions of the scenario that have an access shortly before, against all of them."""
    flagged = prior_access(txns.where(F.col("scenario") == scenario), access, within_min)
    row = flagged.agg(F.count_if("has_prior_access").alias("n_matched"), F.count(F.lit(1)).alias("n_total"))
    return row.select("n_matched", "n_total", _verdict(F.col("n_matched") == F.col("n_total")))


def early_rows(txns: DataFrame, access: DataFrame) -> DataFrame:
    """Transactions before the first access of the whole log."""
    return txns.where(F.col("timestamp") < access.agg(F.min("timestamp")).scalar())
