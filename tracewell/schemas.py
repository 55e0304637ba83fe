"""Explicit schemas of the input tables and of the nested results."""

from pyspark.sql import types as T


def _s(**fields: str) -> T.StructType:
    kinds = {"s": T.StringType(), "d": T.DoubleType(), "i": T.IntegerType(), "l": T.LongType(), "t": T.TimestampType()}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in fields.items()])


ACCESS = _s(employee_id="s", role="s", account_id="s", account_type="s", branch_code="s",
            action_type="s", timestamp="t", records_accessed="i", is_suspicious="i")

TRANSACTIONS = _s(transaction_id="s", account_id="s", amount="d", transaction_type="s", counterparty_id="s",
                  timestamp="t", branch_code="s", is_fraud="i", scenario="s")

LEDGER_RAW = _s(step="i", type="s", amount="d", nameOrig="s", oldbalanceOrg="d", newbalanceOrig="d",
                nameDest="s", oldbalanceDest="d", newbalanceDest="d", isFraud="i", isFlaggedFraud="i")

# The driver's event table; access and transaction views are derived from it.
EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])

# Rows kept by the burst buffer, many in one entry, and what it emits.
BURST_BUFFER = "account_id array<string>, transaction_id array<string>, at array<long>, amount array<double>"
BURST_OUT = _s(account_id="s", slice="l", transaction_id="s", timestamp="t", amount="d",
               cluster_count="i", aggregate_amount="d").add("rule_matched", T.BooleanType())

# One line of a replayed event stream.
EVENT_LINES = _s(topic="s", payload="s", timestamp="t", topic_rank="i", event_key="s")

# Replaces a missing key of an event.
DEFAULTS = {
    "access": {"employee_id": "EMP_UNKNOWN", "account_id": "ACC_UNKNOWN", "role": "staff", "branch_code": "BR_001",
               "account_type": "savings", "action_type": "read", "records_accessed": 1, "is_suspicious": 0},
    "transactions": {"account_id": "ACC_UNKNOWN", "counterparty_id": "EXT_UNKNOWN", "amount": 0.0,
                     "transaction_type": "TRANSFER", "branch_code": "BR_001", "is_fraud": 0, "scenario": "normal"},
}
