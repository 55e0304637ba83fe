"""Per-account history: gaps, rolling rows, past-only statistics, first occurrences, recent rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell import constants as C
from tracewell.functions import columns as X
from tracewell.operators.ordering import null_safe_join, spread_running
from tracewell.operators.skew import Blocks, hot_keys, numbered, ordered_blocks, split_by_heat
from tracewell.operators.stats import group_stats

KEY = "account_id"


def order_of(df: DataFrame, ts: str = "timestamp") -> list[str]:
    """Time plus a unique id, whichever of the known ids the table has."""
    for unique in ("transaction_id", "txn_key", "event_id"):
        if unique in df.columns:
            return [ts, unique]
    raise ValueError("an ordered operator needs a unique id column")


def gap_column(b: Blocks, ts: str = "timestamp", first: float = 9999.0, cap: float = 10000.0) -> Column:
    """Minutes since the account's row before, ``first`` when there is none, at most ``cap``."""
    gap = X.gap_minutes(F.lag(ts).over(b.over), F.col(ts))
    return F.least(F.coalesce(gap, F.lit(first)), F.lit(cap))


def txn_gaps(df: DataFrame, first: float = 9999.0, cap: float = 10000.0, key: str = KEY) -> DataFrame:
    b = ordered_blocks(df, [key], order_of(df), reach=1)
    return b.finish(b.df.withColumn("time_since_last_minutes", gap_column(b, first=first, cap=cap)))


def step_gaps(df: DataFrame, cap: float = 100.0, key: str = KEY) -> DataFrame:
    """Loader form of the gap: ledger steps (hours), first row 0."""
    b = ordered_blocks(df, [key], order_of(df), reach=1)
    hours = (X.micros("timestamp") - X.micros(F.lag("timestamp").over(b.over))) / F.lit(3.6e9)
    gap = F.least(F.coalesce(hours, F.lit(0.0)), F.lit(cap))
    return b.finish(b.df.withColumn("time_since_last_steps", gap))


def rolling_sum(b: Blocks, col: Column | str, n: int) -> Column:
    return F.sum(col).over(b.over.rowsBetween(-(n - 1), 0))


def rolling(df: DataFrame, n: int = 3, key: str = KEY) -> DataFrame:
    """Sums of amount, in-band rows and fast rows over the last n rows."""
    b = ordered_blocks(df, [key], order_of(df), reach=n + 1)
    staged = (b.df.withColumn("time_since_last_minutes", gap_column(b))
              .withColumn("is_struct_band", X.amount_flags()["is_struct_band"])
              .withColumn("is_fast", X.flag(F.col("time_since_last_minutes") <= C.FAST_MINUTES)))
    return b.finish(staged.withColumn("cumulative_amount_window", rolling_sum(b, "amount", n))
                    .withColumn(f"roll_struct_band_{n}", rolling_sum(b, "is_struct_band", n))
                    .withColumn(f"roll_fast_{n}", rolling_sum(b, "is_fast", n)))


def velocity(df: DataFrame, n: int = 5, key: str = KEY) -> DataFrame:
    """Fast rows among the last n, and the row count of the last 3."""
    b = ordered_blocks(df, [key], order_of(df), reach=n + 1)
    staged = b.df.withColumn("is_fast", X.flag(gap_column(b) <= C.FAST_MINUTES))
    return b.finish(staged.withColumn("velocity_count", rolling_sum(b, "is_fast", n))
                    .withColumn("rolling_velocity_3", F.count("amount").over(b.over.rowsBetween(-2, 0)).cast("double")))


def homogeneity_column(b: Blocks, n: int = 3) -> Column:
    """Deviation over (mean + 1) of the last n amounts, 0 for a first row, held in [0, 5]."""
    w = b.over.rowsBetween(-(n - 1), 0)
    ratio = F.try_divide(F.stddev_samp("amount").over(w), F.avg("amount").over(w) + 1.0)
    return F.least(F.greatest(F.coalesce(ratio, F.lit(0.0)), F.lit(0.0)), F.lit(5.0))


def homogeneity(df: DataFrame, n: int = 3, key: str = KEY) -> DataFrame:
    b = ordered_blocks(df, [key], order_of(df), reach=n)
    return b.finish(b.df.withColumn("amount_homogeneity", homogeneity_column(b, n)))


def normalised_amount(df: DataFrame, key: str = KEY) -> DataFrame:
    """Amount over (account mean + 1); the mean is aggregated and joined back."""
    stats = group_stats(df, [key], "amount").select(key, "mean_amount")
    return (null_safe_join(df, stats, [key], "left")
            .withColumn("amount_normalised", X.safe_ratio("amount", "mean_amount")).drop("mean_amount"))


def past_stats(df: DataFrame, key: str = KEY) -> DataFrame:
    """Count, mean, deviation and maximum of the account's earlier amounts, and the account's first time."""
    cold, hot = split_by_heat(df, [key])
    order = order_of(df)
    w = Window.partitionBy(key).orderBy(*order)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    plain = cold.select(
        "*", (F.row_number().over(w) - 1).cast("double").alias("historical_txn_count"),
        zero(F.avg("amount").over(past)).alias("historical_mean_amount"),
        zero(F.stddev_samp("amount").over(past)).alias("historical_std_amount"),
        zero(F.max("amount").over(past)).alias("historical_max_amount"),
        F.min("timestamp").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("first_seen"))
    if hot is None:
        return plain
    # Running sums about the account's own mean, so that squares do not swamp the deviation.
    centre = hot.groupBy(key).agg(F.avg("amount").alias("_mu"), F.min("timestamp").alias("first_seen"))
    # A NULL amount counts as a row only, as in a window.
    rows = null_safe_join(hot, centre, [key], small=True).withColumn("_d", F.coalesce(F.col("amount") - F.col("_mu"), F.lit(0.0)))
    one = F.col("amount").isNotNull().cast("int")
    run = spread_running(rows, [key], order, {
        "_n": ("sum", F.lit(1)), "_k": ("sum", one), "_s": ("sum", F.col("_d")), "_q": ("sum", F.col("_d") * F.col("_d")),
        "_top": ("max", F.col("amount"))})
    n, k = (F.col("_n") - 1).cast("double"), (F.col("_k") - one).cast("double")
    s, q = F.col("_s") - F.col("_d"), F.col("_q") - F.col("_d") * F.col("_d")
    mean = F.try_divide(s, k)
    var = F.greatest(F.try_divide(q - s * mean, k - 1.0), F.lit(0.0))
    # The maximum of earlier rows: the running maximum, moved one row down.
    b = ordered_blocks(run, [key], order, reach=1)
    shifted = b.finish(b.df.withColumn("_prev_top", F.lag("_top").over(b.over)))
    done = shifted.select(
        *df.columns, n.alias("historical_txn_count"), zero(mean + F.col("_mu")).alias("historical_mean_amount"),
        zero(F.when(k > 1, F.sqrt(var))).alias("historical_std_amount"),
        zero(F.col("_prev_top")).alias("historical_max_amount"), "first_seen")
    return plain.unionByName(done)


def past_count(df: DataFrame, by: list[str], name: str = "past_count") -> DataFrame:
    """Earlier rows of the same group."""
    return numbered(df, by, order_of(df), name).withColumn(name, F.col(name) - 1)


def dormancy(df: DataFrame, key: str = KEY) -> DataFrame:
    """Days since the account's row before (999 for a first row) and the dormancy flag."""
    b = ordered_blocks(df, [key], order_of(df), reach=1)
    days = X.gap_seconds(F.lag("timestamp").over(b.over), F.col("timestamp")) / 86400.0
    out = b.df.withColumn("days_since_last_transaction", F.coalesce(days, F.lit(999.0)))
    return b.finish(out.withColumn("is_dormant_account", X.flag(F.col("days_since_last_transaction") > C.DORMANT_DAYS)))


def account_age(df: DataFrame, key: str = KEY) -> DataFrame:
    """Hours since the account's first row."""
    first = df.groupBy(key).agg(F.min("timestamp").alias("_first"))
    return (null_safe_join(df, first, [key], "left")
            .withColumn("account_age_steps", X.gap_seconds("_first", "timestamp") / 3600.0).drop("_first"))


def new_counterparty(df: DataFrame, key: str = KEY, other: str = "counterparty_id") -> DataFrame:
    """1 on the first row of each (account, counterparty).

    One window over the pair; when a pair is too heavy for that, its first id is aggregated instead.
    """
    order = order_of(df)
    if hot_keys(df, [key, other]) is None:
        first = F.row_number().over(Window.partitionBy(key, other).orderBy(*order)) == 1
        return df.withColumn("is_new_counterparty", X.flag(first))
    firsts = (df.groupBy(key, other).agg(F.min_by(order[1], F.struct(*order)).alias("_first"))
              .select(F.col("_first"), F.lit(True).alias("_hit")))
    return (df.join(firsts, F.col(order[1]) == F.col("_first"), "left")
            .withColumn("is_new_counterparty", X.flag(F.col("_hit"))).drop("_first", "_hit"))


def type_matches(df: DataFrame, key: str = KEY, col: str = "type") -> DataFrame:
    """1 when the row has the same type as the account's row before, 0 on a first row."""
    b = ordered_blocks(df, [key], order_of(df), reach=1)
    return b.finish(b.df.withColumn("type_matches_history", X.flag(F.col(col) == F.lag(col).over(b.over))))


def last_n(df: DataFrame, n: int = C.BUFFER_ROWS, key: str = KEY) -> DataFrame:
    """The last n rows of every account, with their rank from the newest."""
    order = [F.desc(c) for c in order_of(df)]
    return numbered(df, [key], order, "recency").where(F.col("recency") <= n)


def last_access(access: DataFrame, key: str = KEY) -> DataFrame:
    """Newest access per account."""
    latest = access.groupBy(key).agg(F.max_by(F.struct(*access.columns), F.struct("timestamp", "event_id")).alias("_a"))
    return latest.select("_a.*")
