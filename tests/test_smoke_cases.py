"""Hand-worked cases with asserted values."""

import pytest
from build import access, ledger, txns
from pyspark.sql import functions as F

from tracewell import constants as C
from tracewell.functions import columns as X
from tracewell.functions import text
from tracewell.operators import detect, graph, history, links, profile, risk, roles, structuring


def test_link_pair(spark):
    a = access(spark, {"timestamp": "2026-09-01 10:00:00"})
    t = txns(spark, {"timestamp": "2026-09-01 10:02:30", "amount": 48500.0})
    row = links.temporal_link(a, t).collect()
    assert len(row) == 1
    assert (row[0].gap_seconds, row[0].gap_minutes, row[0].access_before_txn) == (150.0, 2.5, True)


def test_link_window_is_closed_on_both_sides(spark):
    a = access(spark, {"timestamp": "2026-09-01 10:00:00"})
    t = txns(spark, *[{"timestamp": ts} for ts in ("2026-09-01 09:56:00", "2026-09-01 09:55:59", "2026-09-01 10:04:00", "2026-09-01 10:04:01", "2026-09-01 10:00:00")])
    assert {r.transaction_id for r in links.temporal_link(a, t).collect()} == {"TXN_000000", "TXN_000002", "TXN_000004"}


def test_ring(spark):
    t = txns(spark, {"account_id": "ACC_B", "counterparty_id": "ACC_C", "amount": 49500.0, "timestamp": "2026-09-01 10:15:00"},
             {"account_id": "ACC_A", "counterparty_id": "ACC_B", "amount": 50000.0, "timestamp": "2026-09-01 10:00:00"},
             {"account_id": "ACC_C", "counterparty_id": "ACC_A", "amount": 49000.0, "timestamp": "2026-09-01 10:30:00"})
    row = detect.find_rings(access(spark, {"timestamp": "2026-09-01 10:00:00"}), t).collect()
    assert len(row) == 1
    r = row[0]
    assert (r.cycle_length, r.total_quantum, r.severity, r.cycle_path) == (3, 148500.0, "CRITICAL", "ACC_A ➔ ACC_B ➔ ACC_C ➔ ACC_A")
    assert r.ring_score == pytest.approx(0.9)


def test_burst_rule(spark):
    rows = [(42500.0, "14:10"), (45100.0, "14:28"), (48900.0, "14:52"), (46200.0, "15:15")]
    t = txns(spark, *[{"amount": m, "timestamp": f"2026-09-01 {at}:00"} for m, at in rows])
    last = structuring.burst_result(t).where("transaction_id = 'TXN_000003'").head()
    assert (last.rule_matched, last.cluster_count, last.aggregate_amount, last.burst_score) == (True, 4, 182700.0, 0.9)
    assert last.burst_evidence.startswith("Detected 4 rapid transfers in a 2.0-hour window")


def test_label_and_rule_differ_on_a_large_row(spark):
    rows = [(40000.0, "10:00"), (60000.0, "10:10"), (40000.0, "10:20"), (40000.0, "10:30")]
    t = txns(spark, *[{"amount": m, "timestamp": f"2026-09-01 {at}:00"} for m, at in rows])
    assert structuring.label_bursts(t).agg(F.sum("is_structuring")).head()[0] == 0
    assert structuring.burst_rule(t).where("transaction_id = 'TXN_000003'").head().rule_matched


def test_label_marks_every_row_of_a_window(spark):
    rows = ["10:00", "11:00", "12:00", "15:00"]
    t = txns(spark, *[{"amount": 30000.0, "timestamp": f"2026-09-01 {at}:00"} for at in rows])
    got = {r.transaction_id: (r.ends_burst, r.is_structuring) for r in structuring.label_bursts(t).collect()}
    assert got == {"TXN_000000": (0, 1), "TXN_000001": (0, 1), "TXN_000002": (1, 1), "TXN_000003": (0, 0)}


def test_link_features_and_score(spark):
    a = access(spark, {"timestamp": "2026-09-01 10:14:00"})
    t = txns(spark, {"timestamp": "2026-09-01 10:18:00", "amount": 250000.0})
    r = links.score_pairs(links.temporal_link(a, t)).head()
    assert (r.time_delta_minutes, r.role_account_match, r.amount_zscore, r.link_score, r.link_suspicious) == (4.0, 0.0, 16.0, 1.0, True)
    assert r.link_drivers == ["Tight temporal link: 4.0 mins between access and funds departure", "Role mismatch: loan_officer accessed savings account",
                              "Anomalous transaction value: INR 250,000.00 (16.0x baseline)"]


def test_profile_score_and_reasons(spark):
    df = spark.createDataFrame([(345000.0, 850.0, 3200.0, 64.0, 0.0)], "amount double, historical_mean_amount double, historical_max_amount double, days double, nb double")
    ready = df.select("*", (F.col("amount") / (F.col("historical_mean_amount") + 1)).alias("amount_vs_historical_mean_ratio"),
                      (F.col("days") > 30).cast("double").alias("is_dormant_account"), (F.col("nb") == 0).cast("double").alias("balance_is_zero_after"))
    r = profile.profile_reasons(profile.profile_score(ready)).head()
    assert (r.profile_score, r.profile_anomalous) == (0.85, True)
    assert [(x.feature, x.shap_contribution, x.value) for x in r.profile_reasons] == [
        ("is_dormant_account", 0.42, 1.0), ("amount_vs_historical_mean_ratio", 0.38, 405.4), ("balance_is_zero_after", 0.25, 1.0)]


def test_composite(spark):
    df = spark.createDataFrame([("ACC_10017", 0.88, 2.5, True, ["2.5m gap"], 0.72, True, 1)],
                               "account_id string, link_score double, link_gap double, link_suspicious boolean, link_drivers array<string>, profile_score double, profile_anomalous boolean, is_fraud int")
    df = df.withColumn("timestamp", F.lit("2026-09-01 10:02:30").cast("timestamp")).withColumn(
        "profile_reasons", F.array(F.struct(F.lit("amount").alias("feature"), F.lit(None).cast("double").alias("value"), F.lit(0.25).alias("shap_contribution"), F.lit("Huge surge").alias("explanation"))))
    r = risk.build_alerts(df, ["account_id"]).head()
    assert (r.composite_risk_score, r.severity, r.incident_key) == (82.2, "CRITICAL", "temporal_link")
    assert r.evidence_points == ["Funds transferred within 2.5 minutes of internal employee lookup (4-min window trigger).", "2.5m gap", "amount: Huge surge"]
    assert r.alert_title == "CRITICAL Anomaly: Isolation Forest (4-Minute Temporal Link) + XGBoost + SHAP (Profile Deviation)"
    assert r.module_scores == {"temporal_link": 0.88, "xgboost_profile": 0.72}
    assert r.historical_incident_parallel.quantum == "INR 400 Crore"


def test_emit_rule_and_label_flag(spark):
    df = spark.createDataFrame([("a", 0.15, 0.1, 0), ("b", 0.15, 0.1, 1)], "account_id string, profile_score double, burst_score double, is_fraud int")
    df = df.withColumn("timestamp", F.current_timestamp())
    assert [r.account_id for r in risk.build_alerts(df, ["account_id"]).collect()] == ["b"]
    assert risk.build_alerts(df, ["account_id"], use_label_flag=False).count() == 0


def test_role_fallback(spark):
    a = access(spark, {"timestamp": "2026-09-01 02:45:00", "role": "savings_representative", "action_type": "override", "records_accessed": 18})
    r = roles.unusual_features(roles.role_score(roles.serving_features(a))).head()
    assert (r.role_error, round(r.role_threshold, 4), r.role_anomalous) == (0.12, 0.1601, False)
    assert r.role_drivers[0] == "action_type_rarity (val: 0.8, error: 0.000)"


def test_asof_takes_the_last_access_within_tolerance(spark):
    a = access(spark, *[{"timestamp": f"2026-09-01 {t}"} for t in ("10:00:00", "10:05:00", "10:05:00", "10:30:00")])
    t = txns(spark, *[{"timestamp": f"2026-09-01 {t}"} for t in ("10:05:00", "10:15:00", "10:15:01", "09:59:59")])
    got = {r.transaction_id: r.access_id for r in links.asof_access(t, a).collect()}
    assert got == {"TXN_000000": 2, "TXN_000001": 2}


def test_first_pair_sees_only_what_arrived(spark):
    a = access(spark, *[{"timestamp": f"2026-09-01 {t}"} for t in ("10:00:00", "10:01:00", "10:03:00")])
    t = txns(spark, {"timestamp": "2026-09-01 10:01:00"})
    assert [r.access_id for r in links.first_pair(a, t).collect()] == [0]
    late = links.first_pair(a, t, per="access", arrived=True).collect()
    assert [(r.access_id, r.gap_seconds) for r in late] == [(2, 120.0)]


def test_gaps_and_dormancy(spark):
    t = txns(spark, {"timestamp": "2026-01-01 00:00:00"}, {"timestamp": "2026-01-01 00:30:00"}, {"timestamp": "2026-02-05 00:00:00"})
    got = [r.time_since_last_minutes for r in history.txn_gaps(t).orderBy("timestamp").collect()]
    assert got == [9999.0, 30.0, 10000.0]
    days = [(round(r.days_since_last_transaction, 2), r.is_dormant_account) for r in history.dormancy(t).orderBy("timestamp").collect()]
    assert days == [(999.0, 1.0), (0.02, 0.0), (34.98, 1.0)]


def test_sequence_is_padded_in_front(spark):
    t = txns(spark, *[{"amount": float(i), "timestamp": f"2026-01-01 0{i}:00:00"} for i in range(1, 4)])
    seq = {r.amount: [v[0] for v in r.sequence] for r in structuring.sequence_tensor(t, ["amount"], 4).collect()}
    assert seq == {1.0: [0, 0, 0, 1], 2.0: [0, 0, 1, 2], 3.0: [0, 1, 2, 3]}


def test_profile_uses_only_the_past(spark):
    rows = [(100.0, "2026-01-01 00:00:00"), (300.0, "2026-01-02 00:00:00"), (800.0, "2026-01-03 12:00:00")]
    df = ledger(spark, *[{"amount": a, "timestamp": t} for a, t in rows])
    got = [(r.historical_txn_count, r.historical_mean_amount, round(r.historical_std_amount, 4), r.historical_max_amount, r.account_age_steps, r.is_new_counterparty, r.type_matches_history)
           for r in profile.profile_features(df).orderBy("txn_key").collect()]
    assert got == [(0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0), (1.0, 100.0, 0.0, 100.0, 24.0, 0.0, 1.0), (2.0, 200.0, 141.4214, 300.0, 60.0, 0.0, 1.0)]


def test_number_texts(spark):
    row = spark.range(1).select(text.fmt_fixed(F.lit(2.25)), text.fmt_fixed(F.lit(0.15)), text.fmt_money(F.lit(1234567.891)), text.fmt_signed(F.lit(-0.5)),
                                text.fmt_signed(F.lit(0.25)), text.round_even(F.lit(57.25), 1), text.fmt_fixed(F.lit(12345.678))).head()
    assert tuple(row) == ("2.2", "0.1", "1,234,567.89", "-0.500", "+0.250", 57.2, "12345.7")


def test_small_columns(spark):
    df = spark.createDataFrame([("2026-01-03 07:59:00", "it_admin", "audit", "cash_out")], "ts string, role string, kind string, type string")
    ts = F.to_timestamp("ts")
    r = df.select(X.weekday_of(ts), X.weekend(ts), X.off_hours(ts), X.role_allows("role", "kind"), X.role_allows(F.lit("x"), "kind"),
                  X.encode_type("type", "link"), X.encode_type(F.lit("ODD"), "profile"), X.squash(F.lit(0.0)), X.safe_ratio(F.lit(5.0), F.lit(-1.0)),
                  X.decay(ts, F.to_timestamp(F.lit("2026-01-03 08:59:00"))), X.step_hour(F.lit(49))).head()
    assert tuple(r)[:9] == (5, 1.0, True, True, False, 1.0, 4.0, 0.5, None)
    assert r[9] == pytest.approx(0.6976763, rel=1e-6) and r[10] == 1.0
    assert spark.range(1).select(X.step_time(F.lit(25)).cast("string")).head()[0] == "2026-01-02 01:00:00"


def test_nodes_keep_first_seen_attributes(spark):
    a = access(spark, {"timestamp": "2026-01-01 10:00:00", "branch_code": "BR_001"}, {"timestamp": "2026-01-01 12:00:00", "branch_code": "BR_002"})
    t = txns(spark, {"timestamp": "2026-01-01 11:00:00", "account_id": "ACC_2", "counterparty_id": "ACC_10017", "amount": 5.0})
    got = {r.id: r for r in graph.build_nodes(a, t).collect()}
    assert got["ACC_10017"].account_type == "savings" and got["ACC_10017"].access_count == 2 and got["ACC_10017"].total_inflow == 5.0
    assert got["ACC_10017"].total_outflow is None and got["EMP_0019"].branch == "BR_001"
    assert got["ACC_2"].account_type is None and got["ACC_2"].txn_count == 1


def test_thresholds_are_known_for_every_role():
    assert set(C.ROLE_THRESHOLDS) == set(C.ROLES) == set(C.ROLE_ACCOUNT_TYPES)
