"""Sinks: alerts, CSV tables, JSON case exports, dense ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.operators.ordering import positions

CSV_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"  # the default keeps milliseconds only


def write_alerts(alerts: DataFrame, path: str, fmt: str = "parquet", mode: str = "append") -> None:
    alerts.write.mode(mode).format(fmt).save(path)


def alert_sink(path: str, fmt: str = "parquet") -> Callable[[DataFrame, int], None]:
    """foreachBatch writer; a batch that is run again replaces its own folder instead of repeating rows."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").format(fmt).save(f"{path.rstrip('/')}/batch={batch_id}")
    return write


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """Sorted CSV; part files follow the order, so their concatenation is sorted. Times keep their microseconds."""
    df.orderBy(*order).write.mode("overwrite").option("header", True).option("timestampFormat", CSV_TIME).csv(path)


def with_dense_id(df: DataFrame, prefix: str = "TXN_", order: list[str | Column] = ("timestamp",), width: int = 6,
                  name: str = "transaction_id") -> DataFrame:
    """Zero-padded id by position in the given order; wider numbers keep all their digits."""
    numbered = positions(df, [], list(order), "_n")
    digits = F.col("_n").cast("string")
    padded = F.lpad(digits, F.greatest(F.lit(width), F.length(digits)), F.lit("0"))
    return numbered.withColumn(name, F.concat(F.lit(prefix), padded)).drop("_n")


def case_filter(alerts: DataFrame, severity: str = "ALL", term: str = "") -> DataFrame:
    """Case list search: severity equal or ALL; term inside the id or the title, any case."""
    out = alerts if severity.upper() == "ALL" else alerts.where(F.upper("severity") == severity.upper())
    if term:
        needle = term.lower()
        out = out.where(F.lower("alert_id").contains(needle) | F.lower("alert_title").contains(needle))
    return out


def to_json_rows(df: DataFrame, name: str = "payload") -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def export_cases(alerts: DataFrame, path: str, severity: str = "ALL", term: str = "") -> None:
    case_filter(alerts, severity, term).write.mode("overwrite").json(path)
