"""Per-key ordered windows that stay bounded when one key holds a large share of all rows.

A pre-aggregated count finds the heavy keys (at most rows / limit of them). When there are none the
plain per-key window is used. Otherwise the heavy keys' rows are numbered by range partitioning and cut
into blocks of consecutive rows; each block also gets the last few rows of the block before it, marked,
so that frames of a fixed number of rows see exactly what they would see in the uncut key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tracewell.operators.ordering import Order, null_safe_join, spread_positions
from tracewell.session import plan_bytes, setting

HOT_ROWS = 5_000_000
_MIN_ROW_BYTES = 8


def hot_keys(df: DataFrame, by: list[str]) -> DataFrame | None:
    """Keys with more rows than one window partition should hold, or None when there are none."""
    spark = df.sparkSession
    limit = setting(spark, "hotRows", HOT_ROWS)
    size = plan_bytes(df)
    if size is not None and size < limit * _MIN_ROW_BYTES:
        return None
    heavy = df.groupBy(*by).count().where(F.col("count") > limit).select(*by)
    rows = heavy.collect()
    return spark.createDataFrame(rows, heavy.schema) if rows else None


def split_by_heat(df: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ordinary keys, and rows of heavy keys if there are any."""
    hot = hot_keys(df, by)
    if hot is None:
        return df, None
    return null_safe_join(df, hot, by, "left_anti", small=True), null_safe_join(df, hot, by, "left_semi", small=True)


def numbered(df: DataFrame, by: list[str], order: Order, name: str) -> DataFrame:
    """1-based row number per key in a unique order, heavy keys included."""
    cold, hot = split_by_heat(df, by)
    plain = cold.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
    return plain if hot is None else plain.unionByName(spread_positions(hot, by, order, name))


@dataclass
class Blocks:
    """Rows ready for ordered windows: ``over`` is the window, ``finish`` removes the helper rows."""

    df: DataFrame
    by: list[str]
    order: list[str | Column]
    split: bool

    @property
    def over(self) -> WindowSpec:
        keys = [*self.by, "_block"] if self.split else self.by
        return Window.partitionBy(*keys).orderBy(*self.order)

    @property
    def own(self) -> Column:
        """True on rows that belong to the block, false on rows repeated from the block before."""
        return ~F.col("_repeat") if self.split else F.lit(True)

    def finish(self, out: DataFrame) -> DataFrame:
        return out.where(~F.col("_repeat")).drop("_block", "_repeat") if self.split else out


def ordered_blocks(df: DataFrame, by: list[str], order: Order, reach: int) -> Blocks:
    """Cut heavy keys into blocks whose windows may look back ``reach`` rows."""
    cold, hot = split_by_heat(df, by)
    if hot is None:
        return Blocks(df, by, list(order), False)
    size = max(setting(df.sparkSession, "blockRows", 1_000_000), reach + 1)
    place = F.col("_row_at") - 1
    first = F.floor(place / size).cast("long")
    last = F.floor((place + reach) / size).cast("long")
    cut = (spread_positions(hot, by, order, "_row_at")
           .withColumn("_home", first)
           .withColumn("_block", F.explode(F.sequence(first, last)))
           .withColumn("_repeat", F.col("_block") != F.col("_home"))
           .drop("_row_at", "_home"))
    whole = cold.withColumn("_block", F.lit(-1).cast("long")).withColumn("_repeat", F.lit(False))
    return Blocks(whole.unionByName(cut), by, list(order), True)

