"""Bursts of transfers kept under the reporting limit: label, serving rule, features, sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell import constants as C
from tracewell.functions import columns as X
from tracewell.functions import text
from tracewell.operators import history as H
from tracewell.operators.ordering import null_safe_join, running, spread_running
from tracewell.operators.skew import Blocks, numbered, ordered_blocks, split_by_heat
from tracewell.operators.stats import group_stats
from tracewell.session import checkpointed

KEY = H.KEY


def _range_label(df: DataFrame, w_us: int, limit: float, min_n: int, floor: float) -> DataFrame:
    """Two trailing/leading time frames per account."""
    # Decimal sums, as the form for heavy accounts has them: both must agree at the limit.
    base = Window.partitionBy(KEY).orderBy("_us")
    back, ahead = base.rangeBetween(-w_us, 0), base.rangeBetween(0, w_us)
    staged = (df.withColumn("_us", X.micros("timestamp"))
              .withColumn("_n", F.count(F.lit(1)).over(back))
              .withColumn("_top", F.max("amount").over(back))
              .withColumn("_sum", F.sum(F.col("amount").cast("decimal(38,6)")).over(back)))
    ends = X.flag((F.col("_n") >= min_n) & (F.col("_top") < limit) & (F.col("_sum") >= floor))
    return (staged.withColumn("ends_burst", ends.cast("int"))
            .withColumn("is_structuring", F.max("ends_burst").over(ahead))
            .drop("_us", "_n", "_top", "_sum"))


def _swept_label(df: DataFrame, w_us: int, limit: float, min_n: int, floor: float) -> DataFrame:
    """The same label for heavy accounts, from running totals: every frame sum is a difference of two.

    Each row enters at its time and leaves after its window; counts and sums at a row are totals of what
    has entered and not left. Amounts are summed as decimals so that the differences are exact. A NULL amount
    counts as a row and adds nothing, as in a window. Rows get numbers of their own, since ids may repeat.
    """
    key, unique = KEY, "_row"
    df = checkpointed(df.withColumn(unique, F.monotonically_increasing_id()))
    us, money = X.micros("timestamp"), F.coalesce(F.col("amount").cast("decimal(38,6)"), F.lit(0).cast("decimal(38,6)"))
    big = F.when(F.col("amount") >= limit, 1).otherwise(0)
    enter = df.select(key, us.alias("_at"), F.lit(0).alias("_step"), F.col(unique).alias("_id"),
                      F.lit(1).alias("_c"), money.alias("_m"), big.alias("_b"))
    ask = enter.select(key, "_at", F.lit(1).alias("_step"), "_id", F.lit(0).alias("_c"),
                       F.lit(0).cast("decimal(38,6)").alias("_m"), F.lit(0).alias("_b"))
    leave = enter.select(key, (F.col("_at") + w_us).alias("_at"), F.lit(2).alias("_step"), "_id",
                         (-F.col("_c")).alias("_c"), (-F.col("_m")).alias("_m"), (-F.col("_b")).alias("_b"))
    totals = spread_running(enter.unionByName(ask).unionByName(leave), [key], ["_at", "_step", "_id"],
                            {"_n": ("sum", F.col("_c")), "_sum": ("sum", F.col("_m")), "_over": ("sum", F.col("_b"))})
    ends = (totals.where(F.col("_step") == 1)
            .select(key, "_at", "_id", X.flag((F.col("_n") >= min_n) & (F.col("_over") == 0) & (F.col("_sum") >= floor))
                    .cast("int").alias("ends_burst")))
    # A row is labelled when some burst end lies in [its time, its time + window].
    began = ends.select(key, (F.col("_at") - w_us).alias("_at"), F.lit(0).alias("_step"), "_id", F.col("ends_burst").alias("_c"))
    asked = ends.select(key, "_at", F.lit(1).alias("_step"), "_id", F.lit(0).alias("_c"))
    over = ends.select(key, "_at", F.lit(2).alias("_step"), "_id", (-F.col("ends_burst")).alias("_c"))
    open_ends = spread_running(began.unionByName(asked).unionByName(over), [key], ["_at", "_step", "_id"],
                               {"_open": ("sum", F.col("_c"))}).where(F.col("_step") == 1)
    label = (open_ends.select("_id", X.flag(F.col("_open") > 0).cast("int").alias("is_structuring"))
             .join(ends.select("_id", "ends_burst"), "_id"))
    return df.join(label, df[unique] == label["_id"]).select(*[c for c in df.columns if c != unique], "ends_burst", "is_structuring")


def label_bursts(df: DataFrame, window_s: float = C.BURST_WINDOW_SECONDS, limit: float = C.REPORTING_LIMIT,
                 min_n: int = C.BURST_MIN_ROWS, factor: float = C.BURST_FACTOR) -> DataFrame:
    """Training label: rows inside a trailing window with enough rows, all under the limit, summing high enough.

    ``ends_burst`` marks the rows whose own window qualifies; ``is_structuring`` every row of such a window.
    """
    cold, hot = split_by_heat(df, [KEY])
    args = (int(window_s * 1e6), limit, min_n, limit * factor)
    plain = _range_label(cold, *args)
    return plain if hot is None else plain.unionByName(_swept_label(hot, *args))


def burst_rule(df: DataFrame, window_s: float = C.BURST_WINDOW_SECONDS, n: int = C.BUFFER_ROWS,
               limit: float = C.REPORTING_LIMIT, min_n: int = C.BURST_MIN_ROWS, factor: float = C.BURST_FACTOR) -> DataFrame:
    """Serving rule per transaction: rows under the limit among the recent buffer's window ending here.

    A row over the limit is left out, it does not disqualify the window.
    """
    unique = H.order_of(df)[1]
    b = ordered_blocks(df, [KEY], H.order_of(df), reach=n - 1)
    kind = "transaction_type" if "transaction_type" in df.columns else "type"
    frame = b.over.rowsBetween(-(n - 1), 0)
    # Times are compared as numbers and totals read a list of their own: the rows' list, with its texts, is collected only where a query
    # asks for it.
    timed = b.df.withColumn("_us", X.micros("timestamp"))
    buffer = timed.withColumns({"_rows": F.collect_list(F.struct("_us", unique, "timestamp", "amount", kind)).over(frame),
                                "_numbers": F.collect_list(F.struct("_us", "amount")).over(frame)})
    recent, since = F.col("_us") - int(C.BUFFER_HOURS * 3.6e9), F.col("_us") - int(window_s) * 1_000_000
    inside = lambda r: (r["_us"] >= F.greatest(recent, since)) & (r["amount"] < limit)
    total = F.aggregate("_below", F.lit(0.0), lambda s, r: s + r["amount"])
    rows = F.transform(F.filter("_rows", inside), lambda r: F.struct(
        r[unique].cast("string").alias("transaction_id"), r["timestamp"].alias("timestamp"),
        r["amount"].alias("amount"), r[kind].alias("type")))
    below = b.finish(buffer).withColumn("_below", F.filter("_numbers", inside)).withColumn("_total", total)
    return below.withColumns({
        "buffer_rows": F.size(F.filter("_numbers", lambda r: r["_us"] >= recent)), "cluster_rows": rows, "cluster_count": F.size("_below"),
        "aggregate_amount": F.round("_total", 2),
        "rule_matched": (F.size("_below") >= min_n) & (F.col("_total") >= limit * factor)}).drop("_us", "_rows", "_numbers", "_below", "_total")


def burst_totals(df: DataFrame, window_s: float = C.BURST_WINDOW_SECONDS, limit: float = C.REPORTING_LIMIT, min_n: int = C.BURST_MIN_ROWS,
                 factor: float = C.BURST_FACTOR) -> DataFrame:
    """(id, n_below, sum_below, matched): the burst rule over all rows of the window, however many; rows of the same instant count.

    Running totals in time order, so a busy account spreads over tasks: what has come by a row's time less what had by its
    window's start. Sums are decimals, so that differences are exact. Rows without account or time have no totals.
    """
    unique, w = H.order_of(df)[1], int(window_s * 1e6)
    us, below = X.micros("timestamp"), F.col("amount") < limit
    money, zero = F.when(below, F.col("amount").cast("decimal(38,6)")), F.lit(0).cast("decimal(38,6)")
    rows = df.where(F.col(KEY).isNotNull() & F.col("timestamp").isNotNull())
    part = lambda at, step, c, m, sign: rows.select(KEY, at.alias("_at"), F.lit(step).alias("_step"), F.col(unique).alias("_id"), c.alias("_c"), m.alias("_m"), F.lit(sign).alias("_sign"))
    none = F.lit(0).cast("long")
    came = part(us, 1, F.when(below, 1).otherwise(0).cast("long"), F.coalesce(money, zero), 0)
    every = came.unionByName(part(us, 2, none, zero, 1)).unionByName(part(us - w, 0, none, zero, -1))
    totals = running(every, [KEY], ["_at", "_step", "_id"], {"_n": ("sum", F.col("_c")), "_sum": ("sum", F.col("_m"))}).where(F.col("_sign") != 0)
    out = totals.groupBy(F.col("_id").alias(unique)).agg(F.sum(F.col("_n") * F.col("_sign")).alias("n_below"), F.sum(F.col("_sum") * F.col("_sign")).cast("double").alias("sum_below"))
    return out.withColumn("matched", (F.col("n_below") >= min_n) & (F.col("sum_below") >= limit * factor))


def burst_result(df: DataFrame, score: str | None = None, threshold: float = C.BURST_SCORE_THRESHOLD,
                 window_s: float = C.BURST_WINDOW_SECONDS, **rule) -> DataFrame:
    """Detector result: rule or model confidence, cluster rows, total and evidence text."""
    return burst_scores(burst_rule(df, window_s, **rule), score, threshold, window_s)


def burst_scores(out: DataFrame, score: str | None = None, threshold: float = C.BURST_SCORE_THRESHOLD, window_s: float = C.BURST_WINDOW_SECONDS) -> DataFrame:
    """The detector's columns for rows that have cluster_count, aggregate_amount and rule_matched."""
    confidence = F.col(score) if score else F.when(F.col("rule_matched"), 0.90).otherwise(0.10)
    hours = window_s / 3600.0
    evidence = F.concat(
        F.lit("Detected "), F.col("cluster_count").cast("string"), F.lit(f" rapid transfers in a {hours}-hour window, each below "
              "mandatory reporting threshold of INR 50,000. Combined laundered value: INR "),
        text.fmt_money("aggregate_amount"), F.lit("."))
    return (out.withColumn("burst_score", F.round(confidence, 4))
            .withColumn("burst_detected", (confidence >= threshold) | F.col("rule_matched"))
            .withColumn("burst_evidence", evidence))


def sequence_features(df: DataFrame, key: str = KEY) -> DataFrame:
    """The twelve burst features of every row, in one window pass plus one joined mean."""
    kind = "transaction_type" if "transaction_type" in df.columns else "type"
    stats = group_stats(df, [key], "amount").select(key, "mean_amount")
    rows = null_safe_join(df, stats, [key], "left")
    if "oldbalanceorg" not in df.columns:
        rows = rows.withColumn("oldbalanceorg", F.lit(100000.0)).withColumn(
            "newbalanceorg", F.greatest(F.lit(0.0), F.lit(100000.0) - F.col("amount")))
    b = ordered_blocks(rows, [key], H.order_of(df), reach=6)
    staged = (b.df.withColumn("time_since_last_minutes", H.gap_column(b))
              .withColumn("is_fast", X.flag(F.col("time_since_last_minutes") <= C.FAST_MINUTES))
              .withColumns(X.amount_flags()))
    staged = staged.withColumns({
        "amount_normalised": X.safe_ratio("amount", "mean_amount"),
        "is_transfer": X.flag(F.col(kind) == "TRANSFER"),
        "roll_fast_3": H.rolling_sum(b, "is_fast", 3),
        "roll_struct_band_3": H.rolling_sum(b, "is_struct_band", 3),
        "cumulative_amount_window": H.rolling_sum(b, "amount", 3),
        "amount_homogeneity": H.homogeneity_column(b),
        "velocity_count": H.rolling_sum(b, "is_fast", 5),
        "balance_change_ratio": X.safe_ratio(F.col("newbalanceorg") - F.col("oldbalanceorg"), "oldbalanceorg", -10.0, 10.0),
    })
    return b.finish(staged).drop("mean_amount")


def loader_sequence_features(df: DataFrame, key: str = KEY) -> DataFrame:
    """The seven features of the ledger loader; accounts with one row are left out by :func:`keep_active`."""
    stats = group_stats(df, [key], "amount").select(key, "mean_amount")
    rows = null_safe_join(df, stats, [key], "left")
    b = ordered_blocks(rows, [key], H.order_of(df), reach=3)
    hours = (X.micros("timestamp") - X.micros(F.lag("timestamp").over(b.over))) / F.lit(3.6e9)
    staged = b.df.withColumns({
        "amount_norm": X.safe_ratio("amount", F.when(F.col("mean_amount") > 0, F.col("mean_amount")).otherwise(1.0)),
        "time_since_last_steps": F.least(F.coalesce(hours, F.lit(0.0)), F.lit(100.0)),
        **X.amount_flags(),
        "is_transfer": X.flag(F.col("type") == "TRANSFER"),
        "rolling_velocity_3": F.count("amount").over(b.over.rowsBetween(-2, 0)).cast("double"),
        "balance_change_ratio": X.safe_ratio(F.col("newbalanceorg") - F.col("oldbalanceorg"), "oldbalanceorg", -10.0, 10.0),
    })
    return b.finish(staged).drop("mean_amount")


def emit_rows(df: DataFrame, label: str = "is_structuring", stride: int = 2, key: str = KEY) -> DataFrame:
    """Flag the rows that become training sequences: labelled, every ``stride``-th, and the account's last."""
    rows = numbered(df, [key], H.order_of(df), "row_no")
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_size"))
    placed = null_safe_join(rows, sizes, [key])
    i = F.col("row_no") - 1
    emit = (F.col(label) == 1) | (i % stride == 0) | (i == F.col("_size") - 1)
    return placed.withColumn("emitted", emit).drop("_size")


def sequence_tensor(df: DataFrame, cols: list[str], length: int = 30, key: str = KEY, name: str = "sequence") -> DataFrame:
    """Last ``length`` feature vectors up to each row, zero vectors in front where the account is younger."""
    b = ordered_blocks(df, [key], H.order_of(df), reach=length - 1)
    vector = F.array(*[F.col(c).cast("double") for c in cols])
    seen = F.collect_list(vector).over(b.over.rowsBetween(-(length - 1), 0))
    zeros = F.array_repeat(F.array_repeat(F.lit(0.0), len(cols)), F.lit(length) - F.size("_seen"))
    return b.finish(b.df.withColumn("_seen", seen)).withColumn(name, F.concat(zeros, F.col("_seen"))).drop("_seen")


def account_sequences(df: DataFrame, cols: list[str], label: str, length: int = 20, key: str = KEY) -> DataFrame:
    """One sequence per account from its last rows, labelled with the account's highest label."""
    recent = H.last_n(df, length, key)
    vector = F.struct((-F.col("recency")).alias("at"), F.array(*[F.col(c).cast("double") for c in cols]).alias("v"))
    # At most ``length`` rows per account reach the list.
    seqs = recent.groupBy(key).agg(F.array_sort(F.collect_list(vector)).alias("_rows"))
    labels = df.groupBy(key).agg(F.max(label).alias("label"))
    zeros = F.array_repeat(F.array_repeat(F.lit(0.0), len(cols)), F.lit(length) - F.size("_rows"))
    return (seqs.join(labels, key)
            .withColumn("sequence", F.concat(zeros, F.transform("_rows", lambda r: r["v"]))).drop("_rows"))
