"""Pairing transactions with accesses of the same account, and scoring the pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell import constants as C
from tracewell.functions import columns as X
from tracewell.functions import text
from tracewell.operators.evaluate import pair_label
from tracewell.operators.ordering import running
from tracewell.operators.stats import group_stats

_ACCESS_NAMES = {"event_id": "access_id", "timestamp": "access_ts", "branch_code": "access_branch"}
_TXN_NAMES = {"timestamp": "txn_ts", "branch_code": "txn_branch"}


def _renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(c).alias(names.get(c, c)) for c in df.columns])


def as_accesses(access: DataFrame) -> DataFrame:
    return _renamed(access, _ACCESS_NAMES)


def as_payments(txns: DataFrame) -> DataFrame:
    return _renamed(txns, _TXN_NAMES)


def bucketed(access: DataFrame, txns: DataFrame, window_s: float) -> tuple[DataFrame, DataFrame]:
    """Both sides with a time bucket of twice the window; an access goes to every bucket its window touches.

    The bucket joins the account in the key, so one busy account spreads over as many keys as it has
    active buckets and a bucket's candidates are at most twice the pairs in range.
    """
    w = int(window_s * 1e6)
    width = 2 * w
    bucket = lambda us: F.floor(us / F.lit(width)).cast("long")
    left = as_accesses(access)
    ts = X.micros("access_ts")
    left = left.withColumn("_bucket", F.explode(F.sequence(bucket(ts - w), bucket(ts + w))))
    right = as_payments(txns)
    return left, right.withColumn("_bucket", bucket(X.micros("txn_ts")))


def in_window(window_s: float) -> Column:
    gap = F.expr(f"interval {window_s} seconds")
    return F.col("access_ts").between(F.col("txn_ts") - gap, F.col("txn_ts") + gap)


def temporal_link(access: DataFrame, txns: DataFrame, window_s: float = C.LINK_WINDOW_SECONDS) -> DataFrame:
    """All pairs of a transaction and an access of its account at most ``window_s`` apart, in either order."""
    left, right = bucketed(access, txns, window_s)
    pairs = right.join(left, ["account_id", "_bucket"]).where(in_window(window_s)).drop("_bucket")
    return with_gap(pairs)


def count_pairs(access: DataFrame, txns: DataFrame, window_s: float = C.LINK_WINDOW_SECONDS) -> DataFrame:
    """The number of rows of :func:`temporal_link` in one row ``n``, without forming a pair.

    Accesses are counted in time order; a payment takes the count at the end of its window less that before its start.
    """
    w, none = int(window_s * 1e6), F.lit(0).cast("long")
    at = lambda df, us, step, c, sign: df.where("account_id is not null and timestamp is not null").select("account_id", us.alias("_at"), F.lit(step).alias("_step"), c.alias("_c"), F.lit(sign).alias("_sign"))
    ts = X.micros("timestamp")
    rows = at(access, ts, 1, F.lit(1).cast("long"), 0).unionByName(at(txns, ts + w, 2, none, 1)).unionByName(at(txns, ts - w, 0, none, -1))
    total = running(rows, ["account_id"], ["_at", "_step"], {"_n": ("sum", F.col("_c"))})
    return total.agg(F.coalesce(F.sum(F.col("_n") * F.col("_sign")), none).alias("n"))


def with_gap(pairs: DataFrame) -> DataFrame:
    gap = F.abs(X.gap_seconds("access_ts", "txn_ts"))
    return (pairs.withColumn("gap_seconds", gap)
            .withColumn("gap_minutes", text.round_even(F.col("gap_seconds") / 60.0, 2))
            .withColumn("access_before_txn", F.col("access_ts") <= F.col("txn_ts")))


def match_within(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, right_id: str,
                 lo_us: int, hi_us: int, pick: str = "last", name: str = "match") -> DataFrame:
    """For each left row the first or last right row with right_ts in [left_ts + lo, left_ts + hi].

    Linear: both sides are merged in time order inside (key, bucket) windows, so no pair is formed.
    Buckets are three times the reach long, and only right rows near a bucket's edge are repeated.
    ``name`` holds the right row as a struct, NULL where nothing is in range.
    """
    span = hi_us - lo_us
    width = max(3 * span, 60_000_000)
    bucket = lambda us: F.floor(us / F.lit(width)).cast("long")
    right_us = X.micros(right_ts)
    shown = F.struct(*right.columns)
    anchor = X.micros(left_ts) + F.lit(hi_us if pick == "last" else lo_us)
    ends = (right_us, right_us + span) if pick == "last" else (right_us - span, right_us)
    r = right.select(F.col(key).alias("_key"), F.explode(F.sequence(bucket(ends[0]), bucket(ends[1]))).alias("_bucket"),
                     right_us.alias("_at"), F.lit(0).alias("_side"), F.col(right_id).alias("_tie"), shown.alias("_r"))
    l = left.select(F.col(key).alias("_key"), bucket(anchor).alias("_bucket"), anchor.alias("_at"),
                    F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"))
    merged = r.unionByName(l, allowMissingColumns=True)
    if pick == "last":
        order = [F.asc("_at"), F.asc("_side"), F.asc_nulls_last("_tie")]
    else:
        order = [F.desc("_at"), F.asc("_side"), F.desc_nulls_last("_tie")]
    w = Window.partitionBy("_key", "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    near = merged.withColumn("_near", F.last("_r", ignorenulls=True).over(w)).where(F.col("_side") == 1)
    at = X.micros(F.col(f"_near.{right_ts}"))
    inside = F.col("_key").isNotNull() & at.between(X.micros(F.col(f"_l.{left_ts}")) + lo_us, X.micros(F.col(f"_l.{left_ts}")) + hi_us)
    return near.select("_l.*", F.when(inside, F.col("_near")).alias(name))


def asof_access(txns: DataFrame, access: DataFrame, tolerance_min: float = C.ASOF_TOLERANCE_MINUTES,
                keep_unmatched: bool = False) -> DataFrame:
    """Each transaction with the last access of its account at or before it, within the tolerance."""
    acc = as_accesses(access)
    out = match_within(as_payments(txns), acc, "account_id", "txn_ts", "access_ts", "access_id",
                       -int(tolerance_min * 6e7), 0, "last", "_m")
    if not keep_unmatched:
        out = out.where(F.col("_m").isNotNull())
    fields = [c for c in acc.columns if c != "account_id"]
    pairs = out.select(*[c for c in out.columns if c != "_m"], *[F.col(f"_m.{c}").alias(c) for c in fields])
    return with_gap(pairs)


def first_pair(access: DataFrame, txns: DataFrame, per: str = "transaction",
               window_s: float = C.LINK_WINDOW_SECONDS, arrived: bool = False) -> DataFrame:
    """One pair per transaction (its earliest access in the window) or per access (its earliest transaction).

    ``arrived`` keeps only partners that came before the row itself; at equal times the access comes first.
    """
    w = int(window_s * 1e6)
    acc, pay = as_accesses(access), as_payments(txns)
    if per == "transaction":
        out = match_within(pay, acc, "account_id", "txn_ts", "access_ts", "access_id", -w, 0 if arrived else w, "first", "_m")
        other = acc
    else:
        out = match_within(acc, pay, "account_id", "access_ts", "txn_ts", "transaction_id", -w, -1 if arrived else w, "first", "_m")
        other = pay
    fields = [c for c in other.columns if c != "account_id"]
    mine = [c for c in out.columns if c != "_m"]
    found = out.where(F.col("_m").isNotNull())
    return with_gap(found.select(*mine, *[F.col(f"_m.{c}").alias(c) for c in fields]))


def prior_access(txns: DataFrame, access: DataFrame, within_min: float = C.ASOF_TOLERANCE_MINUTES) -> DataFrame:
    """Transactions flagged with whether an access of the account came at most ``within_min`` before."""
    acc = access.select("account_id", F.col("timestamp").alias("access_ts"), F.col("event_id").alias("access_id"))
    out = match_within(txns, acc, "account_id", "timestamp", "access_ts", "access_id", -int(within_min * 6e7), 0, "last", "_m")
    return out.withColumn("has_prior_access", F.col("_m").isNotNull()).drop("_m")


def join_scores(links: DataFrame, roles: DataFrame) -> DataFrame:
    """Scored pairs with the scored accesses they came from, on account and access time."""
    return links.join(roles.withColumnRenamed("timestamp", "access_ts"), ["account_id", "access_ts"])


def with_dimension(df: DataFrame, dim: DataFrame, on: list[str], defaults: dict[str, object]) -> DataFrame:
    """Left lookup with defaults; Spark broadcasts the dimension when it is small."""
    out = df.join(dim, on, "left")
    return out.select(*[F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in out.columns])


def link_features(pairs: DataFrame, zscore: str = "fixed") -> DataFrame:
    """The nine link features. ``zscore``: ``fixed`` baseline (serving) or per ``account`` (training).

    Training keeps the sign of the gap and alphabetical type codes; serving uses the fixed code table.
    """
    if zscore == "account":
        stats = group_stats(pairs, ["account_id"], "amount").select("account_id", "mean_amount", "std_amount")
        pairs = pairs.join(stats, "account_id", "left")
        std = F.coalesce("std_amount", F.lit(1.0))
        z = F.try_divide(F.col("amount") - F.col("mean_amount"), std)
    else:
        z = (F.col("amount") - 10000.0) / 15000.0
    minutes = F.abs(X.gap_minutes("access_ts", "txn_ts")) if zscore == "fixed" else X.gap_minutes("access_ts", "txn_ts")
    out = (pairs.withColumn("time_delta_minutes", minutes)
           .withColumn("amount_zscore", z)
           .withColumn("role_account_match", X.role_allows("role", "account_type").cast("double"))
           .withColumn("hour_of_access", X.hour_of("access_ts").cast("double"))
           .withColumn("day_of_week", X.weekday_of("access_ts").cast("double"))
           .withColumn("transaction_type_encoded", X.encode_type("transaction_type", "link"))
           .withColumn("is_fraud_pair", pair_label("is_suspicious", "is_fraud")))
    return out.drop("mean_amount", "std_amount")


def history_zscore(amount: Column, history: Column) -> Column:
    """Score of an amount against an array of past amounts; population deviation, 0 counts as 1.

    With fewer than two past amounts the fixed baseline applies.
    """
    n = F.size(history).cast("double")
    mean = F.try_divide(F.aggregate(history, F.lit(0.0), lambda s, x: s + x), n)
    var = F.try_divide(F.aggregate(history, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)), n)
    std = F.when(var > 0, F.sqrt(var)).otherwise(F.lit(1.0))
    return F.when(F.size(history) > 1, (amount - mean) / std).otherwise((amount - 10000.0) / 15000.0)


def link_score(df: DataFrame, model_score: str | None = None) -> DataFrame:
    """Anomaly score of a pair, rule-based unless a fitted model's raw score column is named."""
    if model_score:
        score = X.squash(model_score)
    else:
        points = (F.when(F.col("time_delta_minutes") <= 5.0, 0.50).otherwise(0.0)
                  + F.when(F.col("role_account_match") == 0.0, 0.30).otherwise(0.0)
                  + F.when(F.col("amount") > C.REPORTING_LIMIT, 0.20).otherwise(0.0))
        score = F.least(F.lit(1.0), points)
    return (df.withColumn("link_score", F.round(score, 4))
            .withColumn("link_gap", text.round_even(F.col("time_delta_minutes"), 2))
            .withColumn("link_suspicious", (score > C.LINK_SCORE_THRESHOLD) | (F.col("time_delta_minutes") <= 4.0)))


def link_drivers(df: DataFrame, limit: int = 3, name: str = "link_drivers") -> DataFrame:
    """Up to three reasons for a pair's score, in fixed order."""
    gap, z, hour = F.col("time_delta_minutes"), F.col("amount_zscore"), F.col("hour_of_access")
    return df.withColumn(name, text.text_list(
        F.when(gap <= 5.0, F.concat(F.lit("Tight temporal link: "), text.fmt_fixed(gap), F.lit(" mins between access and funds departure"))),
        F.when(F.col("role_account_match") == 0.0,
               F.concat(F.lit("Role mismatch: "), F.col("role"), F.lit(" accessed "), F.col("account_type"), F.lit(" account"))),
        F.when(z > 2.0, F.concat(F.lit("Anomalous transaction value: INR "), text.fmt_money("amount"),
                                 F.lit(" ("), text.fmt_fixed(z), F.lit("x baseline)"))),
        F.when((hour < 8) | (hour > 18), F.concat(F.lit("Off-hours internal access at "), hour.cast("int").cast("string"), F.lit(":00"))),
        limit=limit))


def score_pairs(pairs: DataFrame, zscore: str = "fixed") -> DataFrame:
    return link_drivers(link_score(link_features(pairs, zscore)))
