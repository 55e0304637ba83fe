"""Positions and running totals over a total order, without handing one task the whole order.

Inputs small enough for one task use an ordinary window. Beyond that the rows are range-partitioned
on the full sort key (so a heavy group spreads over many partitions), checkpointed so that the cut
points cannot move, and per-partition results are shifted by the totals of the partitions before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.columns import as_col
from tracewell.session import checkpointed, fits_one_task, setting

Order = Sequence["str | Column"]
_POSITION_BITS = 33


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", small: bool = False) -> DataFrame:
    """Equi join in which NULL keys match each other; the right side's keys are dropped."""
    if not on:
        raise ValueError("a join needs keys")
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    cond = None
    for c in on:
        part = left[c].eqNullSafe(renamed[f"_r_{c}"])
        cond = part if cond is None else cond & part
    joined = left.join(F.broadcast(renamed) if small else renamed, cond, how)
    return joined.drop(*[f"_r_{c}" for c in on])


def _fixed_order(df: DataFrame, by: list[str], order: Order) -> DataFrame:
    """Rows in range partitions of the sort key, with partition number and place kept in a checkpoint."""
    spark = df.sparkSession
    # Size estimates of joins are products and can't tell how many are needed: it is for the session to say.
    parts = setting(spark, "orderPartitions", int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = [F.col(c) for c in by] + [as_col(c) for c in order]
    placed = (df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
              .withColumn("_ord_mid", F.monotonically_increasing_id()))
    fixed = checkpointed(placed)
    return (fixed.withColumn("_ord_part", F.shiftright("_ord_mid", _POSITION_BITS))
            .withColumn("_ord_pos", F.col("_ord_mid").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))))


def spread_positions(df: DataFrame, by: list[str], order: Order, name: str) -> DataFrame:
    """The partition-wise form of :func:`positions`."""
    fixed = _fixed_order(df, by, order)
    before = Window.orderBy("_ord_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range partition.
    starts = (fixed.groupBy("_ord_part").agg(F.count(F.lit(1)).alias("_ord_rows"))
              .select("_ord_part", F.coalesce(F.sum("_ord_rows").over(before), F.lit(0)).alias("_ord_start")))
    out = (fixed.join(F.broadcast(starts), "_ord_part")
           .withColumn(name, F.col("_ord_start") + F.col("_ord_pos") + 1)
           .drop("_ord_part", "_ord_pos", "_ord_mid", "_ord_start"))
    if by:
        firsts = out.groupBy(*by).agg(F.min(name).alias("_ord_first"))
        out = null_safe_join(out, firsts, by).withColumn(name, F.col(name) - F.col("_ord_first") + 1).drop("_ord_first")
    return out


def positions(df: DataFrame, by: list[str], order: Order, name: str = "position") -> DataFrame:
    """1-based position of each row in its group. ``order`` must be unique within a group."""
    if fits_one_task(df):
        w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(*order)
        return df.withColumn(name, F.row_number().over(w).cast("long"))
    return spread_positions(df, by, order, name)


_LOCAL = {"sum": F.sum, "max": F.max, "min": F.min}


def spread_running(df: DataFrame, by: list[str], order: Order, aggs: dict[str, tuple[str, Column]]) -> DataFrame:
    """The partition-wise form of :func:`running`."""
    fixed = _fixed_order(df, by, order)
    inputs = fixed.select("*", *[col.alias(f"_in_{n}") for n, (_, col) in aggs.items()])
    local = Window.partitionBy("_ord_part", *by).orderBy("_ord_mid").rowsBetween(Window.unboundedPreceding, 0)
    prior = Window.partitionBy(*by).orderBy("_ord_part").rowsBetween(Window.unboundedPreceding, -1)
    totals, carries, finals = [], [], []
    for n, (kind, _) in aggs.items():
        src = F.col(f"_in_{n}")
        if kind == "last":
            totals.append(F.max_by(src, F.when(src.isNotNull(), F.col("_ord_mid"))).alias(f"_t_{n}"))
            carries.append(F.last(f"_t_{n}", ignorenulls=True).over(prior).alias(f"_c_{n}"))
        else:
            totals.append(_LOCAL[kind](src).alias(f"_t_{n}"))
            carries.append(_LOCAL[kind](f"_t_{n}").over(prior).alias(f"_c_{n}"))
    # One row per group and range partition it touches.
    carried = inputs.groupBy("_ord_part", *by).agg(*totals).select("_ord_part", *by, *carries)
    for n, (kind, _) in aggs.items():
        here, there = F.col(f"_l_{n}"), F.col(f"_c_{n}")
        if kind == "sum":
            both = F.coalesce(here + there, here, there)
        elif kind == "last":
            both = F.coalesce(here, there)
        else:
            both = F.greatest(here, there) if kind == "max" else F.least(here, there)
        finals.append(both.alias(n))
    run = [(F.last(f"_in_{n}", ignorenulls=True) if kind == "last" else _LOCAL[kind](f"_in_{n}")).over(local).alias(f"_l_{n}")
           for n, (kind, _) in aggs.items()]
    joined = null_safe_join(inputs.select("*", *run), carried, ["_ord_part", *by])
    return joined.select(*df.columns, *finals)


def running(df: DataFrame, by: list[str], order: Order, aggs: dict[str, tuple[str, Column]]) -> DataFrame:
    """Running ``sum``/``max``/``min``/``last`` (non-NULL) up to and including each row of a unique order."""
    if fits_one_task(df):
        w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(*order)
        w = w.rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[
            (F.last(col, ignorenulls=True) if kind == "last" else _LOCAL[kind](col)).over(w).alias(n)
            for n, (kind, col) in aggs.items()])
    return spread_running(df, by, order, aggs)


def previous_value(df: DataFrame, order: Order, col: str, name: str) -> DataFrame:
    """Value of ``col`` on the row before, over the whole table in a unique order."""
    if fits_one_task(df):
        return df.withColumn(name, F.lag(col).over(Window.partitionBy(F.lit(0)).orderBy(*order)))
    fixed = _fixed_order(df, [], order)
    before = Window.orderBy("_ord_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = (fixed.groupBy("_ord_part").agg(F.max_by(F.struct(F.col(col).alias("v")), F.col("_ord_mid")).alias("_tail"))
               .select("_ord_part", F.last("_tail").over(before).alias("_carry")))
    inside = Window.partitionBy("_ord_part").orderBy("_ord_mid")
    return (fixed.join(F.broadcast(carried), "_ord_part")
            .withColumn(name, F.when(F.col("_ord_pos") == 0, F.col("_carry.v")).otherwise(F.lag(col).over(inside)))
            .drop("_ord_part", "_ord_pos", "_ord_mid", "_carry"))
