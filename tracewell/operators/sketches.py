"""Sketches that are stored by day and group, and merged for any range of days.

Quantiles: counts of amounts in buckets whose bounds grow by a fixed factor, as rows (day, group, bucket, count). Merging is adding,
so neither order nor grouping of merges changes anything, and a value is off by at most the share ``alpha``. Distinct counts: the
largest hash rank of each of ``REGISTERS`` shares of the values, as rows (day, group, register, rank). Merging is taking the maximum;
Spark's own sketch is smaller but its estimates change with the order of merges.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALPHA = 0.01  # relative error of a quantile's value
REGISTERS = 4096  # a relative standard error of 1.6 per cent
DISTINCT_ERROR = 0.05  # three standard errors


def _factor(alpha: float) -> float:
    return (1 + alpha) / (1 - alpha)


def bucket(value: Column, alpha: float = ALPHA) -> Column:
    """Number of the bucket of a value: sign, and logarithm of the size; 0 has one of its own, below all positive ones."""
    size = F.ceil(F.log(F.abs(value)) / log(_factor(alpha))).cast("long") + 100_000  # positive for all doubles
    return F.when(value > 0, size).when(value < 0, -size).when(value == 0, F.lit(0).cast("long"))


def bucket_value(number: Column, alpha: float = ALPHA) -> Column:
    """The value that is within ``alpha`` of all values of a bucket."""
    g = _factor(alpha)
    size = 2 * F.exp((F.abs(number) - 100_000) * log(g)) / (g + 1)
    return F.when(number > 0, size).when(number < 0, -size).otherwise(0.0)


def daily_values(df: DataFrame, by: list[str], value: str, ts: str = "timestamp", alpha: float = ALPHA) -> DataFrame:
    """(day, ``by``, bucket, n): what is stored of a value's distribution. NULLs and NaNs are left out."""
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return rows.groupBy(F.to_date(ts).alias("day"), *by, bucket(F.col(value).cast("double"), alpha).alias("bucket")).agg(F.count("*").alias("n"))


def daily_distinct(df: DataFrame, by: list[str], value: str, ts: str = "timestamp") -> DataFrame:
    """(day, ``by``, register, rank): what is stored of a column's distinct values. NULLs are left out."""
    h = F.xxhash64(value)
    rest = F.shiftrightunsigned(h, 12)
    rank = F.when(rest > 0, 53 - F.length(F.bin(rest))).otherwise(53)
    rows = df.where(F.col(value).isNotNull())
    return rows.groupBy(F.to_date(ts).alias("day"), *by, F.pmod(h, F.lit(REGISTERS)).cast("int").alias("register")).agg(F.max(rank).cast("int").alias("rank"))


def _within(table: DataFrame, first: str | None, last: str | None) -> DataFrame:
    table = table if first is None else table.where(F.col("day") >= F.lit(first).cast("date"))
    return table if last is None else table.where(F.col("day") <= F.lit(last).cast("date"))


def quantiles(stored: DataFrame, by: list[str], shares: list[float], first: str | None = None, last: str | None = None, alpha: float = ALPHA) -> DataFrame:
    """(``by``, share, value): the value at rank ceil(share * n) of the days in range, within ``alpha``."""
    merged = _within(stored, first, last).groupBy(*by, "bucket").agg(F.sum("n").alias("n"))
    # Some thousand buckets at most for a group.
    over = Window.partitionBy(*by)
    ranked = merged.withColumns({"_until": F.sum("n").over(over.orderBy("bucket")), "_total": F.sum("n").over(over)})
    asked = ranked.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    rank = F.greatest(F.lit(1), F.ceil(F.col("share") * F.col("_total")))
    return asked.where((F.col("_until") >= rank) & (F.col("_until") - F.col("n") < rank)).select(*by, "share", bucket_value(F.col("bucket"), alpha).alias("value"))


def distinct(stored: DataFrame, by: list[str], first: str | None = None, last: str | None = None) -> DataFrame:
    """(``by``, n_distinct) of the days in range, within ``DISTINCT_ERROR`` but for one in some hundred groups."""
    m = float(REGISTERS)
    merged = _within(stored, first, last).groupBy(*by, "register").agg(F.max("rank").alias("rank"))
    # Whole sums of powers of two in doubles are the same in any order.
    parts = merged.groupBy(*by).agg(F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("s"), F.count("*").alias("k"))
    empty = m - F.col("k")
    raw = 0.7213 / (1 + 1.079 / m) * m * m / (F.col("s") + empty)
    few = F.when((raw <= 2.5 * m) & (empty > 0), m * F.log(m / empty)).otherwise(raw)
    return parts.select(*by, F.round(few).cast("long").alias("n_distinct"))
