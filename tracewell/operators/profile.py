"""Transactions against their own account's past: features, score and reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell import constants as C
from tracewell.functions import columns as X
from tracewell.functions import text
from tracewell.operators import history as H
from tracewell.operators.skew import hot_keys
from tracewell.operators.ordering import null_safe_join
from tracewell.operators.stats import group_stats

KEY = H.KEY


def _type_col(df: DataFrame) -> str:
    return "transaction_type" if "transaction_type" in df.columns else "type"


def with_balances(df: DataFrame) -> DataFrame:
    """Balances a bare transaction is scored with: emptied origin, credited destination."""
    if "oldbalanceorg" in df.columns:
        return df
    return df.withColumns({"oldbalanceorg": F.col("amount"), "newbalanceorg": F.lit(0.0),
                           "oldbalancedest": F.lit(0.0), "newbalancedest": F.col("amount")})


def _ratios() -> dict[str, Column]:
    return {
        "amount_vs_historical_mean_ratio": F.try_divide(F.col("amount"), F.col("historical_mean_amount") + 1.0),
        "amount_vs_historical_max_ratio": F.try_divide(F.col("amount"), F.col("historical_max_amount") + 1.0),
    }


def _past(df: DataFrame) -> DataFrame:
    kind = _type_col(df)
    order = H.order_of(df)
    if hot_keys(df, [KEY]) is None:
        # One shuffle on the account serves all of these windows.
        w = Window.partitionBy(KEY).orderBy(*order)
        past = w.rowsBetween(Window.unboundedPreceding, -1)
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        days = X.gap_seconds(F.lag("timestamp").over(w), F.col("timestamp")) / 86400.0
        out = df.select(
            "*", (F.row_number().over(w) - 1).cast("double").alias("historical_txn_count"),
            zero(F.avg("amount").over(past)).alias("historical_mean_amount"),
            zero(F.stddev_samp("amount").over(past)).alias("historical_std_amount"),
            zero(F.max("amount").over(past)).alias("historical_max_amount"),
            (X.gap_seconds(F.first("timestamp").over(w), F.col("timestamp")) / 3600.0).alias("account_age_steps"),
            F.coalesce(days, F.lit(999.0)).alias("days_since_last_transaction"),
            X.flag(F.col(kind) == F.lag(kind).over(w)).alias("type_matches_history"))
    else:
        out = H.past_stats(df)
        out = out.withColumn("account_age_steps", X.gap_seconds("first_seen", "timestamp") / 3600.0).drop("first_seen")
        out = H.type_matches(H.dormancy(out).drop("is_dormant_account"), col=kind)
    return H.new_counterparty(out)


def from_past(rows: DataFrame) -> DataFrame:
    """The profile features of rows that have their account's past (the columns of ``_past``)."""
    kind = _type_col(rows)
    ob, nb = F.col("oldbalanceorg"), F.col("newbalanceorg")
    return with_balances(rows).withColumns({
        "hour_of_day": X.hour_of("timestamp").cast("double"), "current_amount": F.col("amount"),
        "balance_before": ob, "balance_after": nb, "is_transfer": X.flag(F.col(kind) == "TRANSFER"),
        **_ratios(), **X.balance_residuals(signed=False),
        "balance_drop_ratio": X.safe_ratio(ob - nb, ob, -5.0, 5.0),
        "balance_is_zero_after": X.flag(nb == 0.0),
        "is_dormant_account": X.flag(F.col("days_since_last_transaction") > C.DORMANT_DAYS),
        # Alphabetical code of the two scored channels; others keep the fixed table's code.
        "type_encoded": F.when(F.col(kind) == "CASH_OUT", 0.0).when(F.col(kind) == "TRANSFER", 1.0)
        .otherwise(X.encode_type(kind, "profile")),
    })


def profile_features(df: DataFrame, mode: str = "past") -> DataFrame:
    """The 21 profile features.

    ``past``: only the account's earlier rows count. ``loader``: whole-account statistics and constant
    placeholders. ``placeholder``: the stand-in profile used when no history is kept.
    """
    kind = _type_col(df)
    base = with_balances(df)
    ob, nb = F.col("oldbalanceorg"), F.col("newbalanceorg")
    common = {
        "hour_of_day": X.hour_of("timestamp").cast("double"), "current_amount": F.col("amount"),
        "balance_before": ob, "balance_after": nb, "is_transfer": X.flag(F.col(kind) == "TRANSFER"),
    }
    if mode == "past":
        out = from_past(_past(df))
    elif mode == "loader":
        stats = group_stats(base, [KEY], "amount")
        joined = null_safe_join(base, stats, [KEY], "left").withColumns({
            "historical_mean_amount": F.col("mean_amount"), "historical_max_amount": F.col("max_amount"),
            "historical_txn_count": F.col("n_rows").cast("double")})
        origin = base.agg(F.date_trunc("day", F.min("timestamp")))
        step = (X.micros("timestamp") - X.micros(origin.scalar())) / F.lit(3.6e9)
        steps = F.col("step").cast("double") if "step" in df.columns else step
        out = joined.withColumns({
            **common, **{n: X.clip(c, 0.0, 100.0 if "mean" in n else 10.0) for n, c in _ratios().items()},
            **X.balance_residuals(signed=True),
            "balance_drop_ratio": X.safe_ratio(ob - nb, ob, -10.0, 10.0),
            "balance_is_zero_after": X.flag(nb <= 0.01), "type_encoded": X.encode_type(kind, "loader"),
            "account_age_steps": steps, "hour_of_day": steps % 24, "days_since_last_transaction": F.lit(1.0),
            "is_new_counterparty": F.lit(1.0), "is_dormant_account": F.lit(0.0), "type_matches_history": F.lit(1.0),
            "historical_std_amount": F.lit(0.0),
        }).drop("mean_amount", "std_amount", "max_amount", "n_rows")
    elif mode == "placeholder":
        recent = F.col("buffer_rows") if "buffer_rows" in df.columns else F.lit(1)
        out = base.withColumns({
            "historical_mean_amount": F.col("amount") * 0.20, "historical_max_amount": F.col("amount") * 0.50,
            "historical_std_amount": F.lit(500.0), "historical_txn_count": recent.cast("double"),
            "days_since_last_transaction": F.when(recent <= 2, 15.0).otherwise(1.0), "account_age_steps": F.lit(360.0),
        }).withColumns({
            **common, **_ratios(), **X.balance_residuals(signed=True),
            "is_new_counterparty": F.lit(1.0),
            "balance_drop_ratio": F.when(ob > 0, X.safe_ratio(ob - nb, ob)).otherwise(0.0),
            "balance_is_zero_after": X.flag(nb <= 0.01),
            "type_matches_history": X.flag(F.upper(kind).isin("TRANSFER", "PAYMENT")),
            "is_dormant_account": X.flag(F.col("days_since_last_transaction") > C.DORMANT_DAYS),
            "type_encoded": X.encode_type(kind, "profile"),
        })
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return out


def profile_score(df: DataFrame, score: str | None = None, threshold: float = C.PROFILE_THRESHOLD) -> DataFrame:
    """Mismatch score: rule-based unless a fitted model's probability column is named."""
    raw = F.col(score) if score else F.when(
        (F.col("is_dormant_account") > 0) & (F.col("amount_vs_historical_mean_ratio") > 10), 0.85).otherwise(0.15)
    return df.withColumn("profile_score", F.round(raw, 4)).withColumn("profile_anomalous", raw >= threshold)


def _reason(feature: str, value: Column) -> Column:
    return F.struct(F.lit(feature).alias("feature"), value.cast("double").alias("value"),
                    F.lit(C.PROFILE_REASON_CONTRIBUTIONS[feature]).alias("shap_contribution"),
                    F.lit(C.PROFILE_REASONS[feature]).alias("explanation"))


def profile_reasons(df: DataFrame, name: str = "profile_reasons") -> DataFrame:
    """Rule reasons in fixed order, each with its share and explanation."""
    ratio = F.col("amount_vs_historical_mean_ratio")
    return df.withColumn(name, F.array_compact(F.array(
        F.when(F.col("is_dormant_account") > 0, _reason("is_dormant_account", F.lit(1.0))),
        F.when(ratio > 5.0, _reason("amount_vs_historical_mean_ratio", text.round_even(ratio, 1))),
        F.when(F.col("balance_is_zero_after") > 0, _reason("balance_is_zero_after", F.lit(1.0))))))
