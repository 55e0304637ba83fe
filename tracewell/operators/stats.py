"""Group statistics, rates, counts, histograms, quantiles and correlations."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.ordering import null_safe_join, spread_running
from tracewell.session import checkpointed, fits_one_task


def group_stats(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """Mean, sample deviation, maximum and count of a column per group."""
    return df.groupBy(*by).agg(
        F.avg(col).alias(f"mean_{col}"), F.stddev_samp(col).alias(f"std_{col}"),
        F.max(col).alias(f"max_{col}"), F.count(F.lit(1)).alias("n_rows"))


def with_group_stats(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """Group statistics joined back to the rows: the rows of a heavy group stay spread out."""
    return null_safe_join(df, group_stats(df, by, col), by, "left")


def zscore(df: DataFrame, by: list[str], col: str, name: str | None = None) -> DataFrame:
    """(x - group mean) / group deviation; a single row's deviation counts as 1, deviation 0 gives NULL."""
    joined = with_group_stats(df, by, col)
    z = F.try_divide(F.col(col) - F.col(f"mean_{col}"), F.coalesce(F.col(f"std_{col}"), F.lit(1.0)))
    return joined.withColumn(name or f"{col}_zscore", z).select(*df.columns, name or f"{col}_zscore")


def group_mode(df: DataFrame, by: list[str], col: str, name: str | None = None) -> DataFrame:
    """Most frequent value per group, the smallest on ties."""
    counts = df.where(F.col(col).isNotNull()).groupBy(*by, col).count()
    return counts.groupBy(*by).agg(F.min_by(col, F.struct(-F.col("count"), F.col(col))).alias(name or f"{col}_mode"))


def value_counts(df: DataFrame, cols: list[str], normalize: bool = False, within: list[str] | None = None) -> DataFrame:
    """Row count per value, and its share of the table or of the ``within`` group."""
    counts = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n_rows"))
    if not normalize:
        return counts
    if within:
        totals = df.groupBy(*within).agg(F.count(F.lit(1)).alias("_total"))
        return null_safe_join(counts, totals, within).withColumn("share", F.col("n_rows") / F.col("_total")).drop("_total")
    total = df.agg(F.count(F.lit(1)))
    return counts.withColumn("share", F.col("n_rows") / total.scalar())


def rarity(df: DataFrame, group: str, col: str, name: str | None = None) -> DataFrame:
    """1 - share of the value within its group, one row per (group, value)."""
    freq = value_counts(df, [group, col], normalize=True, within=[group])
    return freq.select(group, col, (1.0 - F.col("share")).alias(name or f"{col}_rarity"))


def profile(df: DataFrame, ts: str, keys: list[str]) -> DataFrame:
    """Row count, time span and distinct counts of the key columns, in one row."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.min(ts).alias("min_ts"), F.max(ts).alias("max_ts"),
                  *[F.countDistinct(k).alias(f"n_{k}") for k in keys])


def null_counts(df: DataFrame) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])


def label_rates(df: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    """Share of positive labels in percent, per group or overall."""
    return df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(label).cast("long").alias("n_positive"),
        (F.avg(label) * 100.0).alias("rate_pct"))


def daily_counts(df: DataFrame, ts: str, label: str | None = None, fill: bool = True) -> DataFrame:
    """Rows per day and positive rows per day; days without rows appear with 0."""
    positive = F.count_if(F.col(label) == 1) if label else F.lit(0)
    days = df.groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n_rows"), positive.cast("long").alias("n_positive"))
    if not fill:
        return days
    span = days.agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return span.join(days, "day", "left").select("day", zero("n_rows"), zero("n_positive"))


def hour_counts(df: DataFrame, ts: str) -> DataFrame:
    return df.groupBy(F.hour(ts).alias("hour")).agg(F.count(F.lit(1)).alias("n_rows"))


def hour_pivot(df: DataFrame, ts: str, col: str, values: list[str]) -> DataFrame:
    """Rows per hour of day, one column per given value, 0 where absent."""
    return df.groupBy(F.hour(ts).alias("hour")).pivot(col, values).count().fillna(0)


def quantiles(df: DataFrame, by: list[str], col: str, probs: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles per group, one column per name in ``probs``.

    Small inputs use Spark's exact percentile. It keeps every distinct value of a group in one buffer, so
    larger inputs are ordered by (group, value) across partitions and only the wanted positions are read.
    """
    rows = df.where(F.col(col).isNotNull()).select(*by, F.col(col).cast("double").alias("_v"))
    if fits_one_task(df):
        return rows.groupBy(*by).agg(*[F.percentile("_v", F.lit(p)).alias(n) for n, p in probs.items()])
    return spread_quantiles(rows, by, probs)


STRETCHES = 4096  # that a group's values are counted in
FEW_GROUPS = 10_000  # whose bounds are broadcast


def _near_quantiles(rows: DataFrame, by: list[str], probs: dict[str, float]) -> DataFrame:
    """The rows that can be a wanted quantile, with the number of rows left out before them (``_skip``) and of the whole group (``_n``).

    Values are counted in stretches between their group's least and greatest, which keep their order; rows of stretches that hold
    no wanted position are left out. However many values there are, a task counts in a few thousand stretches a group.
    """
    v, inf = F.col("_v"), F.lit(float("inf"))
    finite = F.when(F.abs("_v") < inf, v)
    span = checkpointed(rows.groupBy(*by).agg(F.min(finite).alias("_lo"), F.max(finite).alias("_hi")))
    few = span.count() <= FEW_GROUPS  # a shuffle on a handful of groups would send all rows to as many tasks
    if by:
        wide = null_safe_join(rows, span, by, small=few)
    else:
        wide = rows.withColumn("_s", span.select(F.struct("*")).scalar()).select("_v", "_s.*")
    # Halves: the distance of two values may be more than a double holds.
    part = F.try_divide(v / 2 - F.col("_lo") / 2, F.col("_hi") / 2 - F.col("_lo") / 2)
    inside = F.coalesce(F.least(F.floor(part * STRETCHES).cast("int"), F.lit(STRETCHES - 1)), F.lit(0))
    at = F.when(F.isnan("_v"), STRETCHES + 1).when(v == inf, STRETCHES).when(v == -inf, -1).otherwise(inside)
    cut = wide.select(*by, "_v", at.alias("_at"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # one row for each stretch of a group
    upto = group.orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    held = cut.groupBy(*by, "_at").agg(F.count(F.lit(1)).alias("_c"))
    held = held.select("*", F.sum("_c").over(upto).alias("_to"), F.sum("_c").over(group).alias("_n"))
    wanted = F.lit(False)
    for p in probs.values():
        place = F.lit(p) * (F.col("_n") - 1)
        for x in (F.floor(place) + 1, F.ceil(place) + 1):
            wanted = wanted | x.between(F.col("_to") - F.col("_c") + 1, F.col("_to"))
    held = held.withColumn("_wanted", wanted).withColumn("_skip", F.sum(F.when(F.col("_wanted"), 0).otherwise(F.col("_c"))).over(upto))
    return null_safe_join(cut, held.where("_wanted").select(*by, "_at", "_skip", "_n"), [*by, "_at"], small=few).drop("_at")


def spread_quantiles(rows: DataFrame, by: list[str], probs: dict[str, float]) -> DataFrame:
    """Quantiles of ``_v`` by position in a distributed sort of the rows near them."""
    counted = _near_quantiles(rows, by, probs).groupBy(*by, "_v", "_skip", "_n").agg(F.count(F.lit(1)).alias("_c"))
    ends = spread_running(counted, by, ["_v"], {"_end": ("sum", F.col("_c"))})
    placed = ends.withColumn("_end", F.col("_end") + F.col("_skip"))
    picks = []
    for n, p in probs.items():
        at = F.lit(p) * (F.col("_n") - 1)
        lo, hi = F.floor(at) + 1, F.ceil(at) + 1
        start = F.col("_end") - F.col("_c") + 1
        picks += [F.max(F.when(lo.between(start, F.col("_end")), F.col("_v"))).alias(f"_{n}_lo"),
                  F.max(F.when(hi.between(start, F.col("_end")), F.col("_v"))).alias(f"_{n}_hi"),
                  F.max(at - F.floor(at)).alias(f"_{n}_w")]
    wide = placed.groupBy(*by).agg(*picks)
    return wide.select(*by, *[
        (F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_w")).alias(n) for n in probs])


def quantiles_approx(df: DataFrame, by: list[str], col: str, probs: dict[str, float], accuracy: int = 10000) -> DataFrame:
    """One-pass approximate quantiles with bounded buffers."""
    return df.groupBy(*by).agg(*[F.percentile_approx(col, p, accuracy).alias(n) for n, p in probs.items()])


def histogram(df: DataFrame, col: str, bins: int = 50, log: bool = False, by: list[str] | None = None,
              density: bool = False) -> DataFrame:
    """Equal-width counts between the column's minimum and maximum (of log10 when ``log``), maximum in the last bin."""
    by = by or []
    x = F.log10(col) if log else F.col(col).cast("double")
    rows = df.where(F.col(col) > 0) if log else df.where(F.col(col).isNotNull())
    span = rows.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi")).alias("s"))
    placed = rows.select(*by, x.alias("_x")).withColumn("_s", span.scalar())
    width = (F.col("_s.hi") - F.col("_s.lo")) / F.lit(bins)
    slot = F.least(F.floor(F.try_divide(F.col("_x") - F.col("_s.lo"), width)), F.lit(bins - 1))
    counts = (placed.groupBy(*by, F.coalesce(slot, F.lit(0)).cast("int").alias("bin"))
              .agg(F.count(F.lit(1)).alias("n_rows"), F.first("_s").alias("_s")))
    step = (F.col("_s.hi") - F.col("_s.lo")) / F.lit(bins)
    out = counts.withColumn("bin_start", F.col("_s.lo") + F.col("bin") * step)
    if density:
        w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
        out = out.withColumn("density", F.try_divide(F.col("n_rows"), F.sum("n_rows").over(w) * step))
    return out.drop("_s")


def shares(df: DataFrame, col: str) -> DataFrame:
    """Count and share of the table per category."""
    return value_counts(df, [col], normalize=True)


def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row per column: count, mean, deviation, minimum, quartiles, maximum."""
    long = unpivot(df, cols)
    base = long.groupBy("feature").agg(
        F.count("value").alias("n_rows"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    return base.join(quantiles(long, ["feature"], "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75}), "feature")


def unpivot(df: DataFrame, cols: list[str], keep: list[str] | None = None) -> DataFrame:
    typed = df.select(*(keep or []), *[F.col(c).cast("double").alias(c) for c in cols])
    return typed.unpivot(keep or [], cols, "feature", "value")


def corr_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlations of all column pairs, as (feature_a, feature_b, corr)."""
    vectors = VectorAssembler(inputCols=cols, outputCol="v", handleInvalid="skip").transform(df.select(*cols)).select("v")
    matrix = Correlation.corr(vectors, "v").head()[0].toArray()
    rows = [(a, b, float(matrix[i, j])) for i, a in enumerate(cols) for j, b in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, "feature_a string, feature_b string, corr double")


def corr_with_label(df: DataFrame, cols: list[str], label: str) -> DataFrame:
    """Correlation of each column with the label."""
    one = df.agg(*[F.corr(F.col(c).cast("double"), F.col(label).cast("double")).alias(c) for c in cols])
    return one.unpivot([], cols, "feature", "corr")


def mean_gap(df: DataFrame, cols: list[str], label: str) -> DataFrame:
    """Absolute difference of class means per column."""
    one = df.agg(*[F.abs(F.avg(F.when(F.col(label) == 1, F.col(c))) - F.avg(F.when(F.col(label) == 0, F.col(c)))).alias(c)
                   for c in cols])
    return one.unpivot([], cols, "feature", "mean_abs_diff")


def score_quantiles(df: DataFrame, col: str) -> DataFrame:
    """Minimum, maximum, mean, median and the 95th and 99th percentile of a score."""
    base = df.agg(F.min(col).alias("min"), F.max(col).alias("max"), F.avg(col).alias("mean"))
    tail = quantiles(df, [], col, {"median": 0.5, "p95": 0.95, "p99": 0.99})
    return tail.withColumn("_b", base.select(F.struct("*")).scalar()).select("_b.*", "median", "p95", "p99")


def imbalance(df: DataFrame, label: str) -> DataFrame:
    """Class counts and negatives per positive (at least one positive assumed)."""
    pos, neg = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    return df.agg(neg.alias("n_negative"), pos.alias("n_positive"),
                  (neg / F.greatest(F.lit(1), pos)).alias("negatives_per_positive"))


def keep_active(df: DataFrame, key: str, k: int, top: int | None = None) -> DataFrame:
    """Rows of keys with at least ``k`` rows; optionally only the ``top`` busiest keys (ties by key)."""
    active = df.groupBy(key).count().where(F.col("count") >= k)
    if top is not None:
        active = active.orderBy(F.desc("count"), key).limit(top)
    return df.join(active.select(key), key, "left_semi")


def distinct_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Number of distinct keys in both tables together, in each, and in only one of them."""
    both = (a.select(key, F.lit(1).alias("_a"), F.lit(0).alias("_b"))
            .unionByName(b.select(key, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
            .groupBy(key).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b")))
    return both.agg(F.count(F.lit(1)).alias("n_union"), F.sum("_a").alias("n_left"), F.sum("_b").alias("n_right"),
                    F.count_if((F.col("_a") == 1) & (F.col("_b") == 0)).alias("n_left_only"),
                    F.count_if((F.col("_a") == 0) & (F.col("_b") == 1)).alias("n_right_only"))


def minmax(df: DataFrame, col: str, by: list[str] | None = None, name: str | None = None, eps: float | None = None) -> DataFrame:
    """Min-max scaling over the table, or per group with a small constant in the divisor."""
    name = name or f"{col}_norm"
    if by:
        span = df.groupBy(*by).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
        joined = null_safe_join(df, span, by, "left")
        eps = 1e-9 if eps is None else eps
    else:
        span = df.agg(F.struct(F.min(col).alias("lo"), F.max(col).alias("hi")).alias("s"))
        joined = (df.withColumn("_s", span.scalar())
                  .withColumn("_lo", F.col("_s.lo")).withColumn("_hi", F.col("_s.hi")).drop("_s"))
        eps = 0.0 if eps is None else eps
    scaled = F.try_divide(F.col(col) - F.col("_lo"), F.col("_hi") - F.col("_lo") + F.lit(eps))
    return joined.withColumn(name, scaled).drop("_lo", "_hi")

