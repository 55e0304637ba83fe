"""Case files: timeline, evidence and neighbourhood of an alert; run-wide counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions import text
from tracewell.operators import graph as G


def timeline(pairs: DataFrame) -> DataFrame:
    """Access step and transaction step of each linked pair, in time order."""
    access = F.struct(
        F.col("access_ts").alias("timestamp"),
        F.concat(F.lit("Employee "), F.col("employee_id"), F.lit(" ("), F.col("role"), F.lit(")")).alias("actor"),
        F.concat(F.lit("Accessed "), F.col("account_id"), F.lit(" ("), F.col("account_type"), F.lit(") at branch "),
                 F.col("access_branch")).alias("action"),
        F.lit("Initial insider access event").alias("significance"))
    txn = F.struct(
        F.col("txn_ts").alias("timestamp"), F.concat(F.lit("Account "), F.col("account_id")).alias("actor"),
        F.concat(F.coalesce("transaction_type", F.lit("TRANSFER")), F.lit(" of INR "), text.fmt_money("amount"), F.lit(" to "),
                 F.coalesce("counterparty_id", F.lit("External"))).alias("action"),
        F.lit("Fund diversion event").alias("significance"))
    return pairs.withColumn("timeline", F.sort_array(F.array(access, txn)))


def trigger_row() -> object:
    """One-step timeline of an alert's own event."""
    return F.array(F.struct(
        F.col("timestamp"), F.concat(F.lit("Trigger Transaction on "), F.col("account_id")).alias("event"),
        F.col("raw_event.amount").alias("amount"), F.coalesce("raw_event.transaction_type", F.lit("TRANSFER")).alias("type")))


def dossier(alerts: DataFrame, nodes: DataFrame, edges: DataFrame, account: str,
            radius: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Case file of one account: its alerts with timeline and benchmark, and the neighbourhood's nodes and edges.

    The neighbourhood stays two tables: around a hub it is too large for one nested value.
    """
    case = alerts.where(F.col("account_id") == account).select(
        "alert_id", "account_id", "timestamp", "composite_risk_score", "severity", "status", "alert_title", "summary",
        F.col("module_scores").alias("modules"), "top_shap_features", "historical_incident_parallel",
        F.col("historical_incident_parallel").alias("historical_incident_benchmark"), "recommended_action",
        trigger_row().alias("timeline"), F.lit(account).alias("target"), F.lit(radius).alias("radius"))
    near_nodes, near_edges = G.ego_graph(nodes, edges, account, radius)
    return case, near_nodes, near_edges


def neighbourhood_sizes(alerts: DataFrame, edges: DataFrame) -> DataFrame:
    """Alerts with the number of direct neighbours and edges of their account."""
    ends = edges.select(F.col("src").alias("account_id"), F.col("dst").alias("other")).unionByName(
        edges.select(F.col("dst").alias("account_id"), F.col("src").alias("other")))
    sizes = ends.groupBy("account_id").agg(F.count(F.lit(1)).alias("n_edges"), F.countDistinct("other").alias("n_neighbours"))
    return alerts.join(sizes, "account_id", "left")


def telemetry(access: DataFrame, txns: DataFrame, pairs: DataFrame, rings: DataFrame, signals: DataFrame, alerts: DataFrame) -> DataFrame:
    """Event, pattern and alert counts of a run in one row; ``pairs`` is the one row of :func:`links.count_pairs`."""
    n = F.count(F.lit(1))
    flags = signals.agg(F.count_if(F.col("burst_detected")).alias("b"), F.count_if(F.col("profile_anomalous")).alias("p"))
    row = access.agg(n.alias("total_access_events")).select(
        "total_access_events", txns.agg(n).scalar().alias("total_transactions"), alerts.agg(n).scalar().alias("total_alerts"),
        pairs.select("n").scalar().alias("temporal_correlations_detected"), rings.agg(n).scalar().alias("circular_rings_detected"),
        flags.select(F.struct("b", "p")).scalar().alias("_f"))
    return row.select(
        "total_access_events", "total_transactions", "total_alerts", "temporal_correlations_detected", "circular_rings_detected",
        F.col("_f.b").alias("structuring_bursts_detected"), F.col("_f.p").alias("profile_anomalies_detected"),
        (F.col("temporal_correlations_detected") + F.col("circular_rings_detected") + F.col("_f.b")).alias("patterns_detected"))
