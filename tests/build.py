"""Small hand-made tables."""

from pyspark.sql import functions as F

ACCESS = "event_id long, employee_id string, role string, account_id string, account_type string, branch_code string, action_type string, timestamp string, records_accessed int, is_suspicious int"
TXN = "transaction_id string, account_id string, amount double, transaction_type string, counterparty_id string, timestamp string, branch_code string, is_fraud int, scenario string"
LEDGER = "txn_key long, account_id string, counterparty_id string, timestamp string, type string, amount double, oldbalanceorg double, newbalanceorg double, oldbalancedest double, newbalancedest double, isfraud int"


def _timed(df):
    return df.withColumn("timestamp", F.to_timestamp("timestamp"))


def access(spark, *rows):
    base = dict(employee_id="EMP_0019", role="loan_officer", account_id="ACC_10017", account_type="savings", branch_code="BR_006",
                action_type="read", records_accessed=1, is_suspicious=0)
    names = [f.split()[0] for f in ACCESS.split(", ")]
    full = [{**base, "event_id": i, **r} for i, r in enumerate(rows)]
    return _timed(spark.createDataFrame([tuple(r[n] for n in names) for r in full], ACCESS))


def txns(spark, *rows):
    base = dict(account_id="ACC_10017", amount=1000.0, transaction_type="TRANSFER", counterparty_id="EXT_9999", branch_code="BR_001", is_fraud=0, scenario="normal")
    names = [f.split()[0] for f in TXN.split(", ")]
    full = [{**base, "transaction_id": f"TXN_{i:06d}", **r} for i, r in enumerate(rows)]
    return _timed(spark.createDataFrame([tuple(r[n] for n in names) for r in full], TXN))


def ledger(spark, *rows):
    base = dict(account_id="C1", counterparty_id="M1", type="TRANSFER", amount=100.0, oldbalanceorg=1000.0, newbalanceorg=900.0, oldbalancedest=0.0, newbalancedest=100.0, isfraud=0)
    names = [f.split()[0] for f in LEDGER.split(", ")]
    full = [{**base, "txn_key": i, **r} for i, r in enumerate(rows)]
    return _timed(spark.createDataFrame([tuple(r[n] for n in names) for r in full], LEDGER))


def same(got, want, key, tol=1e-9):
    """Asserts equal rows, matched by key; doubles within a relative tolerance."""
    import numpy as np

    g, w = got.toPandas(), want.toPandas()
    assert sorted(g.columns) == sorted(w.columns)
    assert len(g) == len(w)
    g, w = (x.sort_values(key).reset_index(drop=True)[sorted(w.columns)] for x in (g, w))
    for c in g.columns:
        if g[c].dtype.kind == "f":
            assert np.allclose(g[c], w[c], rtol=tol, atol=1e-7, equal_nan=True), c
        else:
            assert (g[c].astype(str) == w[c].astype(str)).all(), c
