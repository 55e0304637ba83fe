"""Slices, interleaving, replay gaps, ids, topics, case search."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell import schemas
from tracewell.functions import columns as X
from tracewell.operators.ordering import positions
from tracewell.plans.registry import access, ledger, query, r, txns, us
from tracewell.session import checkpointed, fresh_dir
from tracewell.sources import committed, readers, slicing, writers
from tracewell.sources.cleaning import drop_incomplete, with_defaults

SLICE = """chosen as (select * from transactions where lower(scenario) = 'temporal_link'),
  sliced as (select * from access_events where account_id in (select account_id from chosen)
    and timestamp between (select min(timestamp) - interval 2 hours from chosen) and (select max(timestamp) + interval 2 hours from chosen)),
  stream as (select timestamp, 'access_events' as topic, 0 as topic_rank, event_id::varchar as event_key, account_id, records_accessed::double as amount from access_events
    union all select timestamp, 'transactions', 1, transaction_id, account_id, amount from transactions)"""


@query("scenario_slice", "select 'access' as kind, event_id::varchar as id from sliced union all select 'transaction', transaction_id from chosen", "at", SLICE)
def scenario_slice(spark, d):
    a, t = slicing.scenario_slice(access(spark, d), txns(spark, d), "Temporal_Link")
    return a.select(F.lit("access").alias("kind"), F.col("event_id").cast("string").alias("id")).union(t.select(F.lit("transaction"), "transaction_id"))


@query("interleave", "select topic, event_key, account_id, epoch_us(timestamp) as ts_us, amount from stream", "at", SLICE)
def interleave(spark, d):
    rows = slicing.interleave(access(spark, d), txns(spark, d))
    number = F.coalesce(F.get_json_object("payload", "$.amount"), F.get_json_object("payload", "$.records_accessed")).cast("double")
    return rows.select("topic", "event_key", F.get_json_object("payload", "$.account_id").alias("account_id"), us("timestamp", "ts_us"), number.alias("amount"))


@query("replay_gaps", """select event_key, gap as gap_seconds, least(0.15, greatest(0.001, gap / 500))::double as delay_seconds from (
  select event_key, greatest(0, (epoch_us(timestamp) - epoch_us(lag(timestamp) over (order by timestamp, topic_rank, event_key))) / 1e6) as gap, row_number() over (order by timestamp, topic_rank, event_key) as n from stream)
  where n > 1 union all select event_key, null, null from (select event_key from stream order by timestamp, topic_rank, event_key limit 1)""", "at", SLICE)
def replay_gaps(spark, d):
    return slicing.replay_gaps(slicing.interleave(access(spark, d), txns(spark, d))).select("event_key", "gap_seconds", "delay_seconds")


@query("scenario_counts", """select s.id as scenario_id, s.e::bigint as expected_events, count(t.transaction_id) as found_events from (values ('temporal_link', 266), ('structuring', 99), ('circular_transfer', 15), ('clean_busy', 255)) s(id, e)
  left join transactions t on lower(t.scenario) = s.id group by all""", "t")
def scenario_counts(spark, d):
    return slicing.scenario_counts(access(spark, d), txns(spark, d)).select("scenario_id", "expected_events", "found_events")


@query("dense_ids", "select transaction_id as source_id, 'TXN_' || lpad(row_number() over (order by timestamp, transaction_id)::varchar, 6, '0') as dense_id from transactions", "t")
def dense_ids(spark, d):
    rows = txns(spark, d).withColumnRenamed("transaction_id", "source_id")
    return writers.with_dense_id(rows, order=["timestamp", "source_id"], name="dense_id").select("source_id", "dense_id")


@query("topic_routing", """select case when event_type in ('view', 'error') then 'access_events' when event_type = 'signup' then 'alerts' else 'transactions' end as topic, count(*) as n_rows from events group by 1""")
def topic_routing(spark, d):
    alias = (F.when(F.col("event_type").isin("view", "error"), "access_logs").when(F.col("event_type") == "signup", "alert_events")
             .when(F.col("event_type") == "click", "synthetic_transactions").otherwise("unknown_topic"))
    return spark.read.parquet(f"{d}/events.parquet").groupBy(X.route_topic(alias).alias("topic")).agg(F.count(F.lit(1)).alias("n_rows"))


@query("typed_ledger", "select txn_key, account_id, amount, type from ledger where type in ('TRANSFER', 'CASH_OUT')", "l")
def typed_ledger(spark, d):
    return readers.scored_types(ledger(spark, d)).select("txn_key", "account_id", "amount", "type")


@query("ledger_shape", """select o_orderkey as source_key, 'C' || o_custkey as account_id, epoch_us(timestamp '2026-01-01' + interval (o_orderkey % 744) hour) as ts_us, o_totalprice as amount from orders""")
def ledger_shape(spark, d):
    raw = spark.read.parquet(f"{d}/orders.parquet").select(
        (F.col("o_orderkey") % 744).cast("int").alias("step"), F.lit("TRANSFER").alias("type"), F.col("o_totalprice").alias("amount"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("nameOrig"), F.lit(0.0).alias("oldbalanceOrg"), F.lit(0.0).alias("newbalanceOrig"),
        F.col("o_orderkey").cast("string").alias("nameDest"), F.lit(0.0).alias("oldbalanceDest"), F.lit(0.0).alias("newbalanceDest"),
        F.lit(0).alias("isFraud"), F.lit(0).alias("isFlaggedFraud"))
    return readers.shape_ledger(raw).select(F.col("counterparty_id").cast("long").alias("source_key"), "account_id", us("timestamp", "ts_us"), "amount")


@query("calendar", """select transaction_id, hour(timestamp)::int as hour_of_day, (isodow(timestamp) - 1)::int as day_of_week, strftime(timestamp, '%Y-%m-%d') as event_date, (isodow(timestamp) >= 6)::int::double as is_weekend,
  (hour(timestamp) < 8 or hour(timestamp) > 18)::int::double as is_off_hours from transactions""", "t")
def calendar(spark, d):
    cols = X.calendar("timestamp")
    return txns(spark, d).select("transaction_id", *[c.cast("string").alias(n) if n == "event_date" else c.alias(n) for n, c in cols.items()])


@query("balance_residuals", """select txn_key, round(newbalanceorg + amount - oldbalanceorg, 4) + 0.0 as signed_orig, round(oldbalancedest + amount - newbalancedest, 4) + 0.0 as signed_dest,
  round(abs(oldbalanceorg - amount - newbalanceorg), 4) as abs_orig, round(least(1e8, abs(newbalancedest - oldbalancedest - amount)), 4) as abs_dest from ledger""", "l")
def balance_residuals(spark, d):
    s, a = X.balance_residuals(True), X.balance_residuals(False)
    return ledger(spark, d).select("txn_key", r(s["errorBalanceOrig"], 4, "signed_orig"), r(s["errorBalanceDest"], 4, "signed_dest"),
                                   r(a["errorBalanceOrig"], 4, "abs_orig"), r(a["errorBalanceDest"], 4, "abs_dest"))


@query("type_codes", """select type, case type when 'TRANSFER' then 0 when 'CASH_OUT' then 1 when 'PAYMENT' then 2 when 'DEBIT' then 3 else 0 end::double as link,
  case type when 'TRANSFER' then 4 when 'CASH_OUT' then 1 when 'PAYMENT' then 3 when 'DEBIT' then 2 else 4 end::double as profile,
  case type when 'TRANSFER' then 4 when 'CASH_OUT' then 1 else 0 end::double as loader, count(*) as n_rows from ledger group by all""", "l")
def type_codes(spark, d):
    counts = ledger(spark, d).groupBy("type").agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.select("type", *[X.encode_type("type", s).alias(s) for s in ("link", "profile", "loader")], "n_rows")


@query("defaults", """select event_id, case when role = 'it_admin' then 'staff' else role end as role, case when branch_code = 'BR_003' then 'BR_001' else branch_code end as branch_code,
  records_accessed::int as records_accessed from access_events where action_type <> 'write'""", "a")
def defaults(spark, d):
    holes = access(spark, d).withColumns({
        "role": F.when(F.col("role") != "it_admin", F.col("role")), "branch_code": F.when(F.col("branch_code") != "BR_003", F.col("branch_code")),
        "employee_id": F.when(F.col("action_type") != "write", F.col("employee_id"))})
    return with_defaults(drop_incomplete(holes, ["employee_id"]), "access").select("event_id", "role", "branch_code", "records_accessed")


@query("row_sample", "select txn_key, amount from ledger where ('0x' || substr(md5('42|' || txn_key), 1, 15))::bigint::double + 0.5 < 0.1::double * 1152921504606846976", "l")
def row_sample(spark, d):
    return readers.sample_rows(ledger(spark, d), 0.1, key="txn_key").select("txn_key", "amount")


@query("csv_round_trip", "select transaction_id, account_id, amount, counterparty_id, epoch_us(timestamp) as ts_us, scenario, row_number() over (order by timestamp, transaction_id) as place from transactions", "t")
def csv_round_trip(spark, d):
    """Payments written as sorted CSV and read back, with their place in the files."""
    folder = fresh_dir(spark, "csv")
    writers.write_csv(txns(spark, d), folder, ["timestamp", "transaction_id"])
    rows = readers.read_transactions(spark, folder, "csv")
    # Rows in the order in which they stand: by file, and within a file by line.
    lined = checkpointed(rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line")))
    return positions(lined, [], ["_file", "_block", "_line"], "place").select("transaction_id", "account_id", "amount", "counterparty_id", us("timestamp", "ts_us"), "scenario", "place")


@query("csv_access", "select employee_id, role, account_id, branch_code, action_type, epoch_us(timestamp) as ts_us, records_accessed::int as records_accessed from access_events", "a")
def csv_access(spark, d):
    """The access log written as CSV and read with its schema; rows whose time can't be read go to :func:`readers.unreadable`."""
    folder = fresh_dir(spark, "csv")
    writers.write_csv(access(spark, d).select(*schemas.ACCESS.names), folder, ["timestamp", "employee_id", "account_id"])
    rows = readers.read_access(spark, folder, "csv")
    good = rows.join(readers.unreadable(rows).select("event_id"), "event_id", "left_anti")
    return good.select("employee_id", "role", "account_id", "branch_code", "action_type", us("timestamp", "ts_us"), "records_accessed")


@query("ledger_head", "select account_id, amount, type from (select * from ledger order by txn_key limit 2000) where type in ('TRANSFER', 'CASH_OUT')", "l")
def ledger_head(spark, d):
    """The first rows of a ledger file: the limit comes before the type filter."""
    folder = fresh_dir(spark, "csv")
    rows = ledger(spark, d)
    zero = lambda n: F.lit(0).cast("int").alias(n)
    raw = rows.select(zero("step"), "type", "amount", F.col("account_id").alias("nameOrig"), F.col("oldbalanceorg").alias("oldbalanceOrg"), F.col("newbalanceorg").alias("newbalanceOrig"), F.col("counterparty_id").alias("nameDest"),
                      F.col("oldbalancedest").alias("oldbalanceDest"), F.col("newbalancedest").alias("newbalanceDest"), F.col("isfraud").alias("isFraud"), zero("isFlaggedFraud"), "txn_key")
    raw.orderBy("txn_key").drop("txn_key").write.option("header", True).csv(folder)
    return readers.read_ledger(spark, folder, types=["TRANSFER", "CASH_OUT"], limit=2000).select("account_id", "amount", "type")


@query("committed_sink", "select transaction_id, amount, epoch_us(timestamp) as ts_us from transactions", "t")
def committed_sink(spark, d):
    """Payments through the sink with a commit list, half of them as a batch and half as a stream, read back."""
    folder, rows = fresh_dir(spark, "committed"), txns(spark, d).select("transaction_id", "amount", "timestamp")
    half = F.pmod(F.crc32("transaction_id"), F.lit(2)) == 0
    committed.write(rows.where(half), f"{folder}/out")
    rows.where(~half).write.parquet(f"{folder}/in")
    query_ = committed.write_stream(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), f"{folder}/out", f"{folder}/checkpoint")
    query_.awaitTermination()
    return committed.read(spark, f"{folder}/out", rows.schema).select("transaction_id", "amount", us("timestamp", "ts_us"))


@query("stacked_tables", """select 'ledger' as source, count(*) as n_rows, round(sum(amount), 2) as total from ledger union all select 'transactions', count(*), round(sum(amount), 2) from transactions""", "tl")
def stacked_tables(spark, d):
    a = ledger(spark, d).select(F.lit("ledger").alias("source"), "account_id", "timestamp", "amount", "type", "oldbalanceorg", "newbalanceorg")
    b = txns(spark, d).select(F.lit("transactions").alias("source"), "account_id", "timestamp", "amount", F.col("transaction_type").alias("type"))
    return a.unionByName(b, allowMissingColumns=True).groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("amount"), 2).alias("total"))
