"""All detectors over both event tables: the batch form of event-by-event scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell import constants as C
from tracewell.operators import graph as G
from tracewell.operators import links as L
from tracewell.operators import profile as P
from tracewell.operators import risk as K
from tracewell.operators import roles as R
from tracewell.operators import structuring as B

_RAW = {
    "kind": "string", "event_id": "string", "amount": "double", "transaction_type": "string", "counterparty_id": "string",
    "branch_code": "string", "is_fraud": "int", "scenario": "string", "employee_id": "string", "role": "string",
    "account_type": "string", "action_type": "string", "records_accessed": "int", "timestamp": "timestamp",
}


def _raw_event(**cols) -> object:
    return F.struct(*[cols.get(n, F.lit(None)).cast(t).alias(n) for n, t in _RAW.items()])


def _raw_txn(ts: str, branch: str) -> object:
    names = ["amount", "transaction_type", "counterparty_id", "is_fraud", "scenario"]
    return _raw_event(kind=F.lit("transaction"), event_id=F.col("transaction_id"), branch_code=F.col(branch),
                      timestamp=F.col(ts), **{n: F.col(n) for n in names})


def first_rings(rings: DataFrame) -> DataFrame:
    """The ring of each account that closed first (then shortest, then by path)."""
    members = rings.select(F.explode("path").alias("account_id"), F.struct("closed_at", "cycle_length", "cycle_path").alias("_o"),
                           F.struct("closed_at", "ring_score", "cycle_path", "total_quantum").alias("r"))
    best = members.groupBy("account_id").agg(F.min_by("r", "_o").alias("r"))
    return best.select("account_id", "r.closed_at", "r.ring_score", F.col("r.cycle_path").alias("ring_path"),
                       F.col("r.total_quantum").alias("ring_quantum"))


def _link_columns(df: DataFrame, present: str) -> DataFrame:
    """Link detector columns, NULL on rows without a partner."""
    scored = L.score_pairs(df)
    names = ["link_score", "link_gap", "link_suspicious", "link_drivers"]
    return scored.withColumns({n: F.when(F.col(present), F.col(n)) for n in names})


SCORED = ["aggregate_amount", "cluster_count", "rule_matched", "profile_score", "profile_anomalous", "is_dormant_account", "amount_vs_historical_mean_ratio", "balance_is_zero_after"]
PARTNER = ["account_id", "access_id", "access_ts", "role", "account_type", "is_suspicious"]
RING = ["ring_score", "ring_path", "ring_quantum"]


def with_rings(rows: DataFrame, first: DataFrame, ring_scenario: str | None = None) -> DataFrame:
    """Ring columns of the transactions that come once their account's first ring is closed."""
    rows = rows.join(first, "account_id", "left")
    due = F.col("closed_at") <= F.col("timestamp")
    if ring_scenario is not None:
        due = due & (F.col("scenario") == ring_scenario)
    return rows.withColumns({n: F.when(due, F.col(n)) for n in RING})


def matched_payments(access: DataFrame, txns: DataFrame, rings: DataFrame | None = None,
                     mode: str = "past", burst_window_s: float = C.BURST_WINDOW_SECONDS, ring_scenario: str | None = None) -> DataFrame:
    """Every transaction with its burst and profile numbers, its account's first ring and the access it links to: what
    :func:`paired_payments` writes texts from."""
    w = int(C.LINK_WINDOW_SECONDS * 1e6)
    rows = B.burst_rule(txns, burst_window_s)
    rows = P.profile_score(P.profile_features(rows, mode))
    keep = [*txns.columns, *SCORED]
    if rings is not None:
        # Joined while the rows are still partitioned by account.
        rows = with_rings(rows, first_rings(rings), ring_scenario)
        keep += RING
    # Numbers only go through the merge, and of the accesses what scores a pair.
    acc = L.as_accesses(access).select(*PARTNER)
    rows = L.match_within(L.as_payments(rows.select(*keep)), acc, "account_id", "txn_ts", "access_ts", "access_id", -w, 0, "first", "_m")
    fields = [c for c in acc.columns if c != "account_id"]
    return rows.select("*", *[F.col(f"_m.{c}").alias(c) for c in fields], F.col("_m").isNotNull().alias("_linked")).drop("_m")


def transaction_signals(access: DataFrame, txns: DataFrame, rings: DataFrame | None = None,
                        mode: str = "past", burst_window_s: float = C.BURST_WINDOW_SECONDS, ring_scenario: str | None = None) -> DataFrame:
    """Link, burst, profile and ring columns of every transaction, as known when it arrived.

    Rings count for every transaction of a member once they are closed; ``ring_scenario`` keeps them to transactions with
    that label.
    """
    return paired_payments(matched_payments(access, txns, rings, mode, burst_window_s, ring_scenario), burst_window_s)


def paired_payments(rows: DataFrame, burst_window_s: float = C.BURST_WINDOW_SECONDS) -> DataFrame:
    """Scores, texts, time and event of transactions that stand beside their access; ``_linked`` tells whether there is one."""
    rows = P.profile_reasons(B.burst_scores(_link_columns(rows, "_linked"), window_s=burst_window_s))
    return rows.withColumn("timestamp", F.col("txn_ts")).withColumn("raw_event", _raw_txn("txn_ts", "txn_branch"))


def paired_accesses(rows: DataFrame) -> DataFrame:
    """The same for accesses that stand beside a transaction; those that are neither linked nor unusual go."""
    scored = R.role_score(R.serving_features(rows.withColumn("timestamp", F.col("access_ts"))))
    rows = R.unusual_features(scored)
    rows = _link_columns(rows.where(F.col("_linked") | F.col("role_anomalous")), "_linked")
    raw_access = _raw_event(kind=F.lit("access"), event_id=F.col("access_id"), branch_code=F.col("access_branch"), timestamp=F.col("access_ts"),
                            **{n: F.col(n) for n in ("employee_id", "role", "account_type", "action_type", "records_accessed")})
    return (rows.withColumn("timestamp", F.when(F.col("_linked"), F.col("txn_ts")).otherwise(F.col("access_ts")))
            .withColumn("raw_event", F.when(F.col("_linked"), _raw_txn("txn_ts", "txn_branch")).otherwise(raw_access)))


def matched_accesses(access: DataFrame, txns: DataFrame) -> DataFrame:
    """Accesses that are unusual for their role or link to an earlier transaction, beside that: what :func:`paired_accesses`
    writes texts from."""
    w = int(C.LINK_WINDOW_SECONDS * 1e6)
    pay = L.as_payments(txns)
    rows = L.match_within(L.as_accesses(access), pay, "account_id", "access_ts", "txn_ts", "transaction_id", -w, -1, "first", "_m")
    fields = [c for c in pay.columns if c != "account_id"]
    rows = rows.select("*", *[F.col(f"_m.{c}").alias(c) for c in fields], F.col("_m").isNotNull().alias("_linked")).drop("_m")
    unusual = R.role_score(rows.withColumn("timestamp", F.col("access_ts")))
    return unusual.where(F.col("_linked") | F.col("role_anomalous")).select(*rows.columns)


def access_signals(access: DataFrame, txns: DataFrame) -> DataFrame:
    """Accesses that link to an earlier transaction, or that are unusual for their role."""
    return paired_accesses(matched_accesses(access, txns))


def all_signals(access: DataFrame, txns: DataFrame, rings: DataFrame | None = None, mode: str = "past",
                burst_window_s: float = C.BURST_WINDOW_SECONDS) -> DataFrame:
    """Both kinds of signal rows in one table, with the event that caused each."""
    return both_kinds(transaction_signals(access, txns, rings, mode, burst_window_s), access_signals(access, txns))


def both_kinds(transactions: DataFrame, accesses: DataFrame) -> DataFrame:
    t, a = K.with_signals(transactions), K.with_signals(accesses)
    cols = ["account_id", "timestamp", "raw_event", *K.SIGNALS]
    left = t.select(F.lit("transaction").alias("source"), F.col("transaction_id").alias("source_id"), *cols)
    right = a.select(F.lit("access").alias("source"), F.col("access_id").cast("string").alias("source_id"), *cols)
    return left.unionByName(right)


def find_rings(access: DataFrame, txns: DataFrame, vecs: DataFrame | None = None) -> DataFrame:
    digraph = G.transfer_digraph(G.build_edges(access, txns))
    return G.ring_summary(G.find_cycles(digraph), digraph, vecs)


def alerts(access: DataFrame, txns: DataFrame, rings: DataFrame | None = None, use_label_flag: bool = True, mode: str = "past",
           burst_window_s: float = C.BURST_WINDOW_SECONDS) -> DataFrame:
    """Alerts of every event; rings are found first unless given."""
    rings = find_rings(access, txns) if rings is None else rings
    return K.build_alerts(all_signals(access, txns, rings, mode, burst_window_s), ["source", "source_id"], use_label_flag)


def alerts_of_matched(payments: DataFrame, accesses: DataFrame, use_label_flag: bool = True, burst_window_s: float = C.BURST_WINDOW_SECONDS) -> DataFrame:
    """The same alerts from the rows of :func:`matched_payments` and :func:`matched_accesses`; only the columns that a query asks for are
    worked out."""
    rows = both_kinds(paired_payments(payments, burst_window_s), paired_accesses(accesses))
    return K.build_alerts(rows, ["source", "source_id"], use_label_flag)
