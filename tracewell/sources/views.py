"""Access, transaction and ledger views over the driver's event and order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.session import use_utc

_ACCESS = {
    "event_id": "event_id",
    "employee_id": "'EMP_' || lpad(cast(event_id % 50 as string), 4, '0')",
    "role": "case (event_id % 50) % 5 when 0 then 'loan_officer' when 1 then 'savings_representative' "
            "when 2 then 'branch_manager' when 3 then 'it_admin' else 'compliance_officer' end",
    "account_id": "'ACC_' || lpad(cast(user_id as string), 5, '0')",
    "account_type": "case event_id % 7 when 0 then 'loan' when 1 then 'mortgage' when 2 then 'savings' "
                    "when 3 then 'checking' when 4 then 'business' when 5 then 'system' else 'audit' end",
    "branch_code": "'BR_' || lpad(cast(1 + (event_id % 50 + case when event_id % 11 = 0 then 1 else 0 end) % 10 as string), 3, '0')",
    "action_type": "case event_id % 20 when 0 then 'override' when 1 then 'transfer' when 2 then 'write' "
                   "when 3 then 'write' else 'read' end",
    "timestamp": "ts",
    "records_accessed": "1 + cast(regexp_extract(props, '[0-9]+', 0) as int) % 5",
    "is_suspicious": "case when event_id % 40 = 0 then 1 else 0 end",
}
_TRANSACTIONS = {
    "transaction_id": "'TXN_' || lpad(cast(event_id as string), 8, '0')",
    "account_id": "'ACC_' || lpad(cast(user_id as string), 5, '0')",
    "amount": "round(value * 1000, 2)",
    "transaction_type": "case event_id % 5 when 0 then 'TRANSFER' when 1 then 'TRANSFER' when 2 then 'CASH_OUT' "
                        "when 3 then 'PAYMENT' else 'DEBIT' end",
    "counterparty_id": "case when event_id % 3 = 0 then 'EXT_' || lpad(cast(event_id % 500 as string), 5, '0') "
                       "else 'ACC_' || lpad(cast((user_id - user_id % 6) + ((user_id % 6) + 1 + event_id % 2) % 6 as string), 5, '0') end",
    "timestamp": "ts",
    "branch_code": "'BR_' || lpad(cast(1 + user_id % 10 as string), 3, '0')",
    "is_fraud": "case when event_id % 25 = 0 then 1 else 0 end",
    "scenario": "case when event_id % 25 <> 0 then case when event_id % 10 = 1 then 'clean_busy' else 'normal' end "
                "when event_id % 75 = 0 then 'temporal_link' when event_id % 75 = 25 then 'structuring' else 'circular_transfer' end",
}
_LEDGER = {
    "txn_key": "o_orderkey",
    "account_id": "'C' || lpad(cast(o_custkey as string), 9, '0')",
    "counterparty_id": "'M' || lpad(cast((o_custkey * 7 + o_orderkey % 5) % 1000 as string), 9, '0')",
    "timestamp": "o_orderdate",
    "type": "case o_orderpriority when '1-URGENT' then 'TRANSFER' when '2-HIGH' then 'CASH_OUT' "
            "when '3-MEDIUM' then 'PAYMENT' when '4-NOT SPECIFIED' then 'CASH_IN' else 'DEBIT' end",
    "amount": "o_totalprice",
    "oldbalanceorg": "o_totalprice * (1 + o_orderkey % 3)",
    "newbalanceorg": "case when o_orderkey % 40 = 0 then cast(0 as double) else o_totalprice * (o_orderkey % 3) end",
    "oldbalancedest": "o_totalprice * 0.5D",
    "newbalancedest": "o_totalprice * 1.5D",
    "isfraud": "case when o_orderkey % 40 = 0 then 1 else 0 end",
}
ACCESS_KINDS = "event_type in ('view', 'error')"
TRANSACTION_KINDS = "event_type in ('purchase', 'click', 'signup')"


def project_access(events: DataFrame) -> DataFrame:
    """Access view of an event table, batch or streaming."""
    return _project(events.where(ACCESS_KINDS), _ACCESS)


def project_transactions(events: DataFrame) -> DataFrame:
    return _project(events.where(TRANSACTION_KINDS), _TRANSACTIONS)


def _project(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    out = df.select(*[F.expr(e).alias(n) for n, e in columns.items()])
    # Stream watermarks and instant arithmetic need the zoned type.
    return out.withColumn("timestamp", F.col("timestamp").cast("timestamp"))


def access_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    use_utc(spark)
    return project_access(spark.read.parquet(f"{sf_dir}/events.parquet"))


def transactions_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    use_utc(spark)
    return project_transactions(spark.read.parquet(f"{sf_dir}/events.parquet"))


def ledger_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    use_utc(spark)
    return _project(spark.read.parquet(f"{sf_dir}/orders.parquet"), _LEDGER)


def _cte(name: str, columns: dict[str, str], source: str, where: str | None) -> str:
    cols = ", ".join(f'{e.replace("0.5D", "0.5::double").replace("1.5D", "1.5::double")} as "{n}"' for n, e in columns.items())
    return f"{name} as (select {cols} from {source}{' where ' + where if where else ''})"


# The same three views as common table expressions for the SQL checks.
ACCESS_CTE = _cte("access_events", _ACCESS, "events", ACCESS_KINDS)
TRANSACTIONS_CTE = _cte("transactions", _TRANSACTIONS, "events", TRANSACTION_KINDS)
LEDGER_CTE = _cte("ledger", _LEDGER, "orders", None)
