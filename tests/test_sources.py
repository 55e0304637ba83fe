import json

import pytest
from build import access, txns
from pyspark.sql import functions as F

from tracewell import schemas
from tracewell.operators import detect, risk
from tracewell.sources import readers, slicing, writers
from tracewell.sources.cleaning import drop_incomplete, with_defaults


def test_csv_round_trip_and_unreadable_times(spark, tables, tmp_path):
    _, t, _ = tables
    writers.write_csv(t, str(tmp_path / "t"), ["timestamp", "transaction_id"])
    back = readers.read_transactions(spark, str(tmp_path / "t"), "csv")
    assert back.count() == t.count() and back.schema.fieldNames() == schemas.TRANSACTIONS.fieldNames()
    assert back.agg(F.round(F.sum("amount"), 2)).head() == t.agg(F.round(F.sum("amount"), 2)).head()
    (tmp_path / "bad.csv").write_text("employee_id,role,account_id,account_type,branch_code,action_type,timestamp,records_accessed,is_suspicious\n"
                                      "E1,it_admin,A1,audit,BR_001,read,2026-01-01 00:00:00,1,0\nE1,it_admin,A1,audit,BR_001,read,not a time,1,0\n")
    log = readers.read_access(spark, str(tmp_path / "bad.csv"), "csv")
    assert readers.unreadable(log).count() == 1 and log.select("event_id").distinct().count() == 2


def test_ledger_limit_comes_before_the_type_filter(spark, tmp_path):
    lines = ["step,type,amount,nameOrig,oldbalanceOrg,newbalanceOrg,nameDest,oldbalanceDest,newbalanceDest,isFraud,isFlaggedFraud"]
    lines += [f"{i},{'PAYMENT' if i < 3 else 'TRANSFER'},10.5,C{i},1,2,M{i},3,4,0,0" for i in range(6)]
    (tmp_path / "l.csv").write_text("\n".join(lines))
    path = str(tmp_path / "l.csv")
    assert readers.read_ledger(spark, path, types=["TRANSFER"]).count() == 3
    assert readers.read_ledger(spark, path, types=["TRANSFER"], limit=4).count() == 1
    row = readers.read_ledger(spark, path).where("account_id = 'C5'").head()
    assert str(row.timestamp) == "2026-01-01 05:00:00" and row.counterparty_id == "M5"


def test_slice_bounds_are_global(spark):
    a = access(spark, {"timestamp": "2026-01-01 08:00:00", "account_id": "A"}, {"timestamp": "2026-01-01 07:59:59", "account_id": "A"},
               {"timestamp": "2026-01-03 12:00:00", "account_id": "A"}, {"timestamp": "2026-01-02 00:00:00", "account_id": "C"})
    t = txns(spark, {"account_id": "A", "timestamp": "2026-01-01 10:00:00", "scenario": "structuring"},
             {"account_id": "B", "timestamp": "2026-01-03 10:00:00", "scenario": "Structuring"}, {"account_id": "C", "timestamp": "2026-01-02 10:00:00"})
    acc, tx = slicing.scenario_slice(a, t, "STRUCTURING")
    assert sorted(r.event_id for r in acc.collect()) == [0, 2] and tx.count() == 2
    acc, tx = slicing.scenario_slice(a, t, "clean_busy")
    assert acc.count() == 4 and tx.count() == 0
    assert slicing.scenario_slice(a, t, "all")[0].count() == 4


def test_interleave_puts_access_first_and_delays_are_held(spark):
    a = access(spark, {"timestamp": "2026-01-01 10:00:00"})
    t = txns(spark, {"timestamp": "2026-01-01 10:00:00"}, {"timestamp": "2026-01-01 10:00:10"}, {"timestamp": "2026-01-02 10:00:00"})
    rows = slicing.replay_gaps(slicing.interleave(a, t)).orderBy(*slicing.STREAM_ORDER).collect()
    assert [r.topic for r in rows] == ["access_events", "transactions", "transactions", "transactions"]
    assert [r.delay_seconds for r in rows] == [None, 0.001, 0.02, 0.15]
    assert json.loads(rows[0].payload)["employee_id"] == "EMP_0019" and json.loads(rows[1].payload)["amount"] == 1000.0


def test_catalogue(spark):
    assert slicing.scenario_catalogue(spark).count() == 4
    assert slicing.get_scenario(spark, "Structuring").head().expected_events == 99
    assert slicing.get_scenario(spark, "all").head().recommended_speed == 500.0
    with pytest.raises(ValueError):
        slicing.get_scenario(spark, "unheard_of")


def test_dense_ids_keep_all_digits(spark):
    rows = spark.range(12).withColumn("timestamp", F.timestamp_seconds(-F.col("id")))
    got = writers.with_dense_id(rows, "T_", ["timestamp"], width=1, name="nid").orderBy("timestamp").collect()
    assert [r.nid for r in got] == [f"T_{i}" for i in range(1, 13)]


def test_case_search_and_export(spark, tables, tmp_path):
    alerts = detect.alerts(*tables[:2], burst_window_s=43200)
    assert writers.case_filter(alerts, "critical").count() == alerts.where("severity = 'CRITICAL'").count() > 0
    one = risk.alert_queue(alerts, limit=1).head()
    assert writers.case_filter(alerts, term=one.alert_id.lower()).count() == 1
    assert risk.alert_by_id(alerts, one.alert_id).head().account_id == one.account_id
    assert risk.alert_by_id(alerts, "none").count() == 0
    writers.export_cases(alerts, str(tmp_path / "cases"), "HIGH")
    assert spark.read.json(str(tmp_path / "cases")).count() == alerts.where("severity = 'HIGH'").count()
    sink = writers.alert_sink(str(tmp_path / "sink"))
    for _ in range(2):
        sink(alerts.limit(3), 0)
    assert spark.read.parquet(str(tmp_path / "sink")).count() == 3


def test_defaults_and_incomplete_rows(spark):
    df = spark.createDataFrame([(None, "E1", None), ("it_admin", None, 4)], "role string, employee_id string, records_accessed int")
    rows = with_defaults(df, "access").orderBy("role").collect()
    assert [(r.role, r.employee_id, r.records_accessed, r.branch_code) for r in rows] == [("it_admin", "EMP_UNKNOWN", 4, "BR_001"), ("staff", "E1", 1, "BR_001")]
    assert drop_incomplete(df, ["employee_id"]).count() == 1


def test_decode(spark):
    df = spark.createDataFrame([('{"account_id": "A", "amount": 2.5, "timestamp": "2026-01-01 00:00:00"}',)], "value string")
    r = readers.decode(df, schemas.TRANSACTIONS).head()
    assert (r.account_id, r.amount, str(r.timestamp), r.scenario) == ("A", 2.5, "2026-01-01 00:00:00", None)
