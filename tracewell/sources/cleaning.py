"""Defaults for missing fields and removal of incomplete rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell import schemas


def with_defaults(df: DataFrame, kind: str) -> DataFrame:
    """Missing fields get the stated default; fields the table lacks are added. ``kind``: access or transactions."""
    table = schemas.DEFAULTS[kind]
    present = [F.coalesce(F.col(c), F.lit(table[c])).alias(c) if c in table else F.col(c) for c in df.columns]
    return df.select(*present, *[F.lit(v).alias(c) for c, v in table.items() if c not in df.columns])


def drop_incomplete(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.na.drop(subset=cols)
