"""Accesses against what their role normally does."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell import constants as C
from tracewell.functions import columns as X
from tracewell.functions import text
from tracewell.operators.links import with_dimension
from tracewell.operators.ordering import null_safe_join, positions
from tracewell.operators.skew import numbered
from tracewell.operators.stats import group_mode, rarity, zscore


def label_codes(df: DataFrame, col: str) -> DataFrame:
    """Code of each distinct value in alphabetical order, from 0."""
    values = df.select(col).where(F.col(col).isNotNull()).distinct()
    return positions(values, [], [col], "_code").select(col, (F.col("_code") - 1).cast("double").alias(f"{col}_encoded"))


def label_encode(df: DataFrame, col: str, codes: DataFrame | None = None) -> DataFrame:
    """Alphabetical code joined to each row; values unknown to ``codes`` get 0."""
    codes = label_codes(df, col) if codes is None else codes
    return with_dimension(df, codes, [col], {f"{col}_encoded": 0.0})


def role_features(access: DataFrame, off_start: int = 9, off_end: int = 18) -> DataFrame:
    """The twelve role features in their training form."""
    cal = X.calendar("timestamp", off_start, off_end)
    rows = access.withColumns({
        "hour_of_day": cal["hour_of_day"].cast("double"), "day_of_week": cal["day_of_week"].cast("double"),
        "is_weekend": cal["is_weekend"], "is_off_hours": cal["is_off_hours"], "_day": cal["event_date"]})
    rows = numbered(rows, ["employee_id", "_day"], ["timestamp", "event_id"], "_seq")
    rows = rows.withColumn("access_frequency_today", F.col("_seq").cast("double")).drop("_seq", "_day")
    rows = zscore(rows, ["employee_id"], "records_accessed")
    home = group_mode(access, ["employee_id"], "branch_code", "_home")
    rows = null_safe_join(rows, home, ["employee_id"], "left")
    rows = rows.withColumn("same_branch_access", X.flag(F.col("branch_code") == F.col("_home"))).drop("_home")
    rows = rows.join(rarity(access, "role", "action_type"), ["role", "action_type"], "left")
    for col in ("action_type", "account_type", "branch_code"):
        rows = label_encode(rows, col, label_codes(access, col))
    return rows


def serving_features(access: DataFrame, codes: dict[str, DataFrame] | None = None) -> DataFrame:
    """The twelve role features as used on a single event: constants stand in for history."""
    rows = access.withColumns({
        "hour_of_day": X.hour_of("timestamp").cast("double"), "day_of_week": X.weekday_of("timestamp").cast("double"),
        "is_weekend": X.weekend("timestamp"), "is_off_hours": X.flag(X.off_hours("timestamp")),
        "records_accessed_zscore": (F.col("records_accessed") - 2.0) / 1.5,
        "access_frequency_today": F.lit(3.0), "same_branch_access": F.lit(1.0),
        "action_type_rarity": F.when(F.col("action_type") == "override", 0.85).otherwise(0.10)})
    for col in ("action_type", "account_type", "branch_code"):
        if codes and col in codes:
            rows = label_encode(rows, col, codes[col])
        else:
            rows = rows.withColumn(f"{col}_encoded", F.lit(0.0))
    return rows


def role_thresholds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(C.ROLE_THRESHOLDS.items()), "role string, role_threshold double")


def role_score(df: DataFrame, thresholds: DataFrame | None = None, error: str | None = None) -> DataFrame:
    """Reconstruction error against the role's threshold; the rule-based error unless a fitted one is named.

    ``thresholds`` has one row per role; without it the stored values apply.
    """
    if thresholds is None:
        rows = df.withColumn("role_threshold", X.lookup(C.ROLE_THRESHOLDS, F.col("role"), C.ROLE_THRESHOLD_DEFAULT))
    else:
        rows = with_dimension(df, thresholds, ["role"], {"role_threshold": C.ROLE_THRESHOLD_DEFAULT})
    raw = F.col(error) if error else F.when(X.off_hours("timestamp"), 0.12).otherwise(0.02)
    limit = F.col("role_threshold")
    return rows.withColumns({
        "role_error": F.round(raw, 5),
        "role_anomalous": raw > limit,
        "role_component": X.clip(F.round(raw, 5) / F.greatest(F.lit(0.01), F.round(limit, 5)), hi=1.0),
    })


def unusual_features(df: DataFrame, errors: list[str] | None = None, name: str = "role_drivers") -> DataFrame:
    """The three features with the largest error, as text; without errors the last three in feature order."""
    entries = F.array(*[
        F.struct((F.lit(0.0) if errors is None else -F.col(errors[i])).alias("m"), F.lit(-i).alias("i"),
                 F.concat(F.lit(f"{f} (val: "), text.fmt_fixed(f), F.lit(", error: "),
                          text.fmt_fixed(F.lit(0.0) if errors is None else F.col(errors[i]), 3), F.lit(")")).alias("t"))
        for i, f in enumerate(C.ROLE_FEATURES)])
    return df.withColumn(name, F.transform(F.slice(F.array_sort(entries), 1, 3), lambda e: e["t"]))
