"""Evidence text, bounded lists and maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions.columns import as_col


def fmt_money(x: Column | str, places: int = 2) -> Column:
    """Thousands separators and fixed places."""
    return F.format_number(as_col(x), places)


def fmt_fixed(x: Column | str, places: int = 1) -> Column:
    """Fixed places without separators; exact halves go to the even digit."""
    return F.replace(F.format_number(as_col(x), places), F.lit(","), F.lit(""))


def fmt_signed(x: Column | str, places: int = 3) -> Column:
    x = as_col(x)
    return F.concat(F.when(x >= 0, F.lit("+")).otherwise(F.lit("")), fmt_fixed(x, places))


def round_even(x: Column | str, places: int) -> Column:
    """Correctly rounded value; exact halves go to the even digit."""
    return fmt_fixed(x, places).cast("double")


def text_list(*items: Column, limit: int | None = None) -> Column:
    """Array of the non-NULL texts, first ``limit`` of them."""
    found = F.array_compact(F.array(*items))
    return F.slice(found, 1, limit) if limit else found


def lists(*arrays: Column, limit: int | None = None) -> Column:
    """Concatenation of text arrays, NULL arrays counting as empty."""
    empty = F.array().cast("array<string>")
    joined = F.concat(*[F.coalesce(a, empty) for a in arrays])
    return F.slice(joined, 1, limit) if limit else joined


def top_abs(names: list[str], values: list[Column], k: int = 3) -> Column:
    """The k entries with the largest magnitude, ties in the given order."""
    entries = F.array(*[
        F.struct((-F.abs(v)).alias("m"), F.lit(i).alias("i"), F.lit(n).alias("feature"), v.alias("value"))
        for i, (n, v) in enumerate(zip(names, values))])
    return F.transform(F.slice(F.array_sort(entries), 1, k),
                       lambda e: F.struct(e["feature"].alias("feature"), e["value"].alias("value")))


def score_map(cols: dict[str, Column], places: int = 3) -> Column:
    """name -> rounded score for the detectors that produced one."""
    entries = F.filter(
        F.array(*[F.struct(F.lit(n).alias("key"), F.round(v, places).alias("value")) for n, v in cols.items()]),
        lambda e: e["value"].isNotNull())
    return F.map_from_entries(entries)
