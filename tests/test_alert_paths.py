"""Counts and merges that the alert queries stand on."""

import random

import pytest
from build import access, txns
from conftest import SF
from pyspark.sql import functions as F

from tracewell.operators import detect, links, structuring
from tracewell.plans import risk_plans
from tracewell.plans.history_plans import BURST_S
from tracewell.sources import views


@pytest.mark.parametrize("limit", [None, 0])
def test_pairs_are_counted_without_being_formed(spark, tuned, limit):
    rng = random.Random(4)
    at = lambda: f"2026-01-01 {rng.randrange(2):02d}:{rng.randrange(0, 60, 2):02d}:00"
    a = access(spark, *[{"account_id": rng.choice(["busy", "busy", "b"]), "timestamp": at()} for _ in range(60)], {"account_id": None, "timestamp": at()}, {"timestamp": None})
    t = txns(spark, *[{"account_id": rng.choice(["busy", "busy", "c"]), "timestamp": at()} for _ in range(60)], {"account_id": None, "timestamp": at()}, {"timestamp": None})
    if limit is not None:
        tuned(singleTaskBytes=limit)
    want = links.temporal_link(a, t, 240).count()
    assert links.count_pairs(a, t, 240).head().n == want > 100
    assert links.count_pairs(a.limit(0), t, 240).head().n == 0


@pytest.mark.parametrize("limit", [None, 0])
def test_bursts_longer_than_the_buffer_are_counted_whole(spark, tuned, limit):
    rng = random.Random(6)
    rows = [{"account_id": rng.choice(["busy"] * 4 + ["b"]), "transaction_id": f"T{k:03d}", "timestamp": f"2026-01-01 {rng.randrange(4):02d}:{rng.randrange(0, 60, 3):02d}:00", "amount": rng.choice([20000.5, 49999.99, 50000.0, None])} for k in range(150)]
    t = txns(spark, *rows, {"transaction_id": "N", "account_id": None, "timestamp": "2026-01-01 00:00:00"})
    if limit is not None:
        tuned(singleTaskBytes=limit)
    got = {r.transaction_id: r for r in structuring.burst_totals(t, 7200).collect()}
    at = lambda r: int(r["timestamp"][11:13]) * 60 + int(r["timestamp"][14:16])
    assert len(got) == 150 and max(r.n_below for r in got.values()) > 20
    for r in rows:
        near = [x["amount"] for x in rows if x["account_id"] == r["account_id"] and 0 <= at(r) - at(x) <= 120 and x["amount"] is not None and x["amount"] < 50000]
        assert (got[r["transaction_id"]].n_below, round(got[r["transaction_id"]].sum_below, 2)) == (len(near), round(sum(near), 2))
        assert got[r["transaction_id"]].matched == (len(near) >= 3 and sum(near) >= 75000)


def test_stored_alerts_are_numbers_and_give_the_alerts_of_the_whole(spark):
    """The stored table holds no texts of alerts; with them written on reading, the alerts are those worked out at once."""
    out = risk_plans.alerts(spark, SF)
    folder = risk_plans._STORED[spark.sparkContext.applicationId, SF]
    names = {n for kind in ("payments", "accesses") for n in spark.read.parquet(f"{folder}/{kind}").columns}
    assert not names & {"raw_event", "link_drivers", "profile_reasons", "role_drivers", "evidence_points", "summary"}
    access, txns = views.access_view(spark, SF), views.transactions_view(spark, SF)
    whole = detect.alerts(access, txns, burst_window_s=BURST_S)
    shown = lambda df: sorted(map(str, df.select("alert_id", "timestamp", "severity", "summary", F.to_json("module_scores"), "raw_event").collect()))
    assert shown(out) == shown(whole) and out.columns == whole.columns


def test_burst_totals_do_not_carry_the_rows_texts(spark):
    """The list of rows, with ids and types, is collected only where it is asked for; totals come from numbers."""
    rows = structuring.burst_rule(views.transactions_view(spark, SF), BURST_S)
    plan = lambda *c: rows.select(*c)._jdf.queryExecution().optimizedPlan().toString()
    assert plan("transaction_id", "aggregate_amount").count("collect_list") == 1 and plan("cluster_rows", "cluster_count").count("collect_list") == 2
    for r in rows.select("cluster_count", "aggregate_amount", "cluster_rows").collect():
        assert len(r.cluster_rows) == r.cluster_count and round(sum(x.amount for x in r.cluster_rows), 2) == r.aggregate_amount
