"""Scalar column helpers: calendar, gaps, decay, ratios, codes and flags."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell import constants as C


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch; accepts timestamps with or without a zone."""
    return F.unix_micros(as_col(ts).cast("timestamp"))


def hour_of(ts: Column | str) -> Column:
    return F.hour(as_col(ts))


def weekday_of(ts: Column | str) -> Column:
    """Day of the week with Monday = 0."""
    return F.weekday(as_col(ts))


def weekend(ts: Column | str) -> Column:
    return (F.weekday(as_col(ts)) >= 5).cast("double")


def off_hours(ts: Column | str, start: int = 8, end: int = 18) -> Column:
    """True outside ``start``..``end`` o'clock (both hours inside); training uses start=9."""
    hour = hour_of(ts)
    return (hour < start) | (hour > end)


def calendar(ts: Column | str, off_start: int = 8, off_end: int = 18) -> dict[str, Column]:
    return {
        "hour_of_day": hour_of(ts),
        "day_of_week": weekday_of(ts),
        "event_date": F.to_date(as_col(ts)),
        "is_weekend": weekend(ts),
        "is_off_hours": off_hours(ts, off_start, off_end).cast("double"),
    }


def gap_seconds(earlier: Column | str, later: Column | str) -> Column:
    """Signed gap in fractional seconds."""
    return (micros(later) - micros(earlier)) / F.lit(1e6)


def gap_minutes(earlier: Column | str, later: Column | str) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(6e7)


def step_time(step: Column | str, origin: str = "2026-01-01 00:00:00") -> Column:
    """Ledger step (hours) to an instant."""
    hours = as_col(step)
    return F.to_timestamp(F.lit(origin)) + F.make_interval(hours=hours)


def step_hour(step: Column | str) -> Column:
    return (as_col(step) % 24).cast("double")


def decay(ts: Column | str, ref: Column | str, lam: float = C.DECAY_LAMBDA) -> Column:
    """Time-decay weight exp(-lam * seconds before ``ref``), 1 for anything later."""
    return F.exp(F.lit(-lam) * clip(gap_seconds(ts, ref), lo=0.0))


def squash(x: Column | str, k: float = 5.0) -> Column:
    return 1.0 / (1.0 + F.exp(F.lit(-k) * as_col(x)))


def clip(x: Column, lo: float | None = None, hi: float | None = None) -> Column:
    if lo is not None:
        x = F.when(x.isNotNull(), F.greatest(x, F.lit(lo)))
    if hi is not None:
        x = F.when(x.isNotNull(), F.least(x, F.lit(hi)))
    return x


def safe_ratio(a: Column | str, b: Column | str, lo: float | None = None, hi: float | None = None) -> Column:
    """a / (b + 1), NULL when the divisor is 0, optionally clipped."""
    return clip(F.try_divide(as_col(a), as_col(b) + 1.0), lo, hi)


def balance_residuals(signed: bool = True) -> dict[str, Column]:
    """Bookkeeping residuals of both sides: signed (serving) or absolute, destination capped (training)."""
    amount, ob, nb = F.col("amount"), F.col("oldbalanceorg"), F.col("newbalanceorg")
    od, nd = F.col("oldbalancedest"), F.col("newbalancedest")
    if signed:
        return {"errorBalanceOrig": nb + amount - ob, "errorBalanceDest": od + amount - nd}
    return {"errorBalanceOrig": F.abs(ob - amount - nb), "errorBalanceDest": clip(F.abs(nd - od - amount), 0.0, 1e8)}


def lookup(mapping: dict, key: Column, default) -> Column:
    """CASE over a small fixed mapping."""
    table = F.create_map(*[F.lit(v) for v in chain.from_iterable(mapping.items())])
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def encode_type(t: Column | str, scheme: str = "link") -> Column:
    """Transaction type code under one of the three fixed code tables."""
    mapping, default = C.TYPE_CODES[scheme]
    return lookup(mapping, F.upper(as_col(t)), default).cast("double")


def role_allows(role: Column | str, account_type: Column | str) -> Column:
    """Whether the role may touch this account type; false for unknown roles."""
    table = F.create_map(*chain.from_iterable(
        (F.lit(r), F.array(*[F.lit(t) for t in kinds])) for r, kinds in C.ROLE_ACCOUNT_TYPES.items()))
    return F.coalesce(F.array_contains(F.try_element_at(table, as_col(role)), as_col(account_type)), F.lit(False))


def flag(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False)).cast("double")


def amount_flags(amount: Column | str = "amount", limit: float = C.REPORTING_LIMIT, low: float = C.BAND_LOW) -> dict[str, Column]:
    amount = as_col(amount)
    return {
        "is_below_threshold": flag(amount < limit),
        "is_struct_band": flag((amount >= low) & (amount < limit)),
    }


def node_kind(node: Column | str) -> Column:
    """Account ids carry a fixed prefix; any other counterparty is external."""
    return F.when(as_col(node).startswith("ACC_"), "account").otherwise("counterparty")


def route_topic(topic: Column | str) -> Column:
    """Canonical topic of an alias; unknown names go to transactions."""
    topic = as_col(topic)
    return (F.when(topic.isin("access_events", "access_logs"), "access_events")
            .when(topic.isin("alerts", "alert_events"), "alerts")
            .otherwise("transactions"))


def hashed_number(*keys: Column | str) -> Column:
    """60 bits of the MD5 of the keys, joined by ``|``: the same in every engine."""
    text = F.concat_ws("|", *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def hashed_unit(*keys: Column | str) -> Column:
    """A number in (0, 1) fixed by its keys."""
    return (hashed_number(*keys).cast("double") + 0.5) / float(1 << 60)
