"""The table of registered queries: a Spark plan and, where SQL can say it, the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.columns import micros
from tracewell.session import STATE_STORE, use_utc
from tracewell.sources import views

Plan = Callable[[SparkSession, str], DataFrame]
PLANS: dict[str, Plan] = {}
SQL: dict[str, str] = {}

_CTES = {"a": views.ACCESS_CTE, "t": views.TRANSACTIONS_CTE, "l": views.LEDGER_CTE}
BURST_HOURS = 12  # events are sparse per account, so bursts are sought in a longer window than the default


def query(name: str, sql: str | None = None, tables: str = "", ctes: str = "") -> Callable[[Plan], Plan]:
    """Registers a plan. ``tables``: letters of the views its SQL reads; ``ctes``: further expressions."""
    def add(plan: Plan) -> Plan:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return plan(spark, sf_dir)

        run.module = plan.__module__.rsplit(".", 1)[-1]
        PLANS[name] = run
        if sql is not None:
            parts = [_CTES[k] for k in tables] + ([ctes] if ctes else [])
            SQL[name] = f"with recursive {', '.join(parts)} {sql}" if parts else sql
        return plan
    return add


def prepare(spark: SparkSession) -> None:
    """UTC, and on a local master as many shuffle partitions as cores in place of the default 200."""
    use_utc(spark)
    if spark.conf.get(STATE_STORE[0], None) != STATE_STORE[1]:
        spark.conf.set(*STATE_STORE)
    sc = spark.sparkContext
    if sc.master.startswith("local") and spark.conf.get("spark.sql.shuffle.partitions") == "200":
        spark.conf.set("spark.sql.shuffle.partitions", str(sc.defaultParallelism))


def us(ts: Column | str, name: str) -> Column:
    """Microseconds since the epoch, the form in which both engines show times."""
    return micros(ts).alias(name)


def r(col: Column | str, places: int = 4, name: str | None = None) -> Column:
    out = F.round(F.col(col) if isinstance(col, str) else col, places) + F.lit(0.0)
    return out.alias(name or (col if isinstance(col, str) else "value"))


access, txns, ledger = views.access_view, views.transactions_view, views.ledger_view
