"""Pairing queries: band, as-of and first-pair joins, pair features and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell import constants as C
from tracewell.functions.columns import role_allows, squash
from tracewell.operators import links as L
from tracewell.operators.skew import ordered_blocks
from tracewell.operators.stats import group_mode
from tracewell.plans.registry import access, query, r, txns

GAP_US = "abs(epoch_us(t.timestamp) - epoch_us(a.timestamp))"
PAIRS = f"""pairs as (
  select t.transaction_id, a.event_id as access_id, t.account_id, a.employee_id, a.role, a.account_type, a.branch_code as access_branch,
         a.records_accessed, a.is_suspicious, t.amount, t.transaction_type, t.counterparty_id, t.is_fraud, t.scenario,
         a.timestamp as access_ts, t.timestamp as txn_ts, {GAP_US} / 1e6 as gap_seconds
  from transactions t join access_events a on t.account_id = a.account_id and {GAP_US} <= 240000000)"""
ASOF = """asof_pairs as (
  select t.transaction_id, a.event_id as access_id, t.account_id, a.employee_id, a.role, a.account_type,
         a.records_accessed, a.is_suspicious, t.amount, t.transaction_type, t.is_fraud,
         a.timestamp as access_ts, t.timestamp as txn_ts
  from transactions t asof join access_events a on t.account_id = a.account_id and t.timestamp >= a.timestamp
  where epoch_us(t.timestamp) - epoch_us(a.timestamp) <= 600000000)"""


def allowed(role: str = "role", kind: str = "account_type") -> str:
    cases = " ".join(f"when '{k}' then {kind} in ({', '.join(repr(x) for x in v)})" for k, v in C.ROLE_ACCOUNT_TYPES.items())
    return f"(case {role} {cases} else false end)"


def type_code(col: str, scheme: str) -> str:
    codes, default = C.TYPE_CODES[scheme]
    return f"(case {col} {' '.join(f'''when '{k}' then {v}''' for k, v in codes.items())} else {default} end)::double"


FEATURES = f"""features as (
  select *, (epoch_us(txn_ts) - epoch_us(access_ts)) / 6e7 as signed_minutes, abs(epoch_us(txn_ts) - epoch_us(access_ts)) / 6e7 as minutes,
         (amount - 10000.0::double) / 15000.0::double as z, {allowed()}::int::double as role_match,
         hour(access_ts)::double as h, (isodow(access_ts) - 1)::double as dow, {type_code('transaction_type', 'link')} as code
  from pairs)"""
SCORED = """scored as (
  select *, least(1.0::double, case when minutes <= 5 then 0.5::double else 0.0::double end + case when role_match = 0 then 0.3::double else 0.0::double end
                  + case when amount > 50000 then 0.2::double else 0.0::double end) as score
  from features)"""


def _pairs(spark, d):
    return L.temporal_link(access(spark, d), txns(spark, d))


@query("temporal_link", f"""select transaction_id, access_id, account_id, employee_id, gap_seconds,
  cast(format('{{:.2f}}', gap_seconds / 60) as double) as gap_minutes, (access_ts <= txn_ts)::int as access_before_txn from pairs""", "at", PAIRS)
def temporal_link(spark, d):
    return _pairs(spark, d).select("transaction_id", "access_id", "account_id", "employee_id", "gap_seconds", "gap_minutes",
                                   F.col("access_before_txn").cast("int").alias("access_before_txn"))


@query("link_first_pair", """select transaction_id, access_id, gap_seconds from (
  select *, row_number() over (partition by transaction_id order by access_ts, access_id) as n from pairs) where n = 1""", "at", PAIRS)
def link_first_pair(spark, d):
    return L.first_pair(access(spark, d), txns(spark, d)).select("transaction_id", "access_id", "gap_seconds")


@query("link_first_per_access", """select access_id, transaction_id, gap_seconds from (
  select *, row_number() over (partition by access_id order by txn_ts, transaction_id) as n from pairs) where n = 1""", "at", PAIRS)
def link_first_per_access(spark, d):
    return L.first_pair(access(spark, d), txns(spark, d), per="access").select("access_id", "transaction_id", "gap_seconds")


@query("asof_pairs", "select transaction_id, access_id, account_id, (epoch_us(txn_ts) - epoch_us(access_ts)) / 6e7 as time_delta_minutes from asof_pairs", "at", ASOF)
def asof_pairs(spark, d):
    pairs = L.asof_access(txns(spark, d), access(spark, d))
    return L.link_features(pairs, "account").select("transaction_id", "access_id", "account_id", "time_delta_minutes")


@query("asof_zscores", """select transaction_id, round((amount - avg(amount) over w) / nullif(coalesce(stddev_samp(amount) over w, 1), 0), 6) + 0.0 as amount_zscore
  from asof_pairs window w as (partition by account_id)""", "at", ASOF)
def asof_zscores(spark, d):
    pairs = L.asof_access(txns(spark, d), access(spark, d))
    return L.link_features(pairs, "account").select("transaction_id", r("amount_zscore", 6))


@query("link_features", """select transaction_id, access_id, minutes as time_delta_minutes, amount, round(z, 6) + 0.0 as amount_zscore,
  role_match as role_account_match, h as hour_of_access, dow as day_of_week, records_accessed::int as records_accessed,
  code as transaction_type_encoded, is_suspicious::int as is_suspicious, ((is_suspicious = 1) or (is_fraud = 1))::int as is_fraud_pair from features""",
       "at", f"{PAIRS}, {FEATURES}")
def link_features(spark, d):
    return L.link_features(_pairs(spark, d)).select(
        "transaction_id", "access_id", "time_delta_minutes", "amount", r("amount_zscore", 6), "role_account_match", "hour_of_access",
        "day_of_week", "records_accessed", "transaction_type_encoded", "is_suspicious", "is_fraud_pair")


@query("link_score", """select transaction_id, access_id, round(score, 4) as link_score, cast(format('{:.2f}', minutes) as double) as link_gap,
  (score > 0.5 or minutes <= 4)::int as link_suspicious from scored""", "at", f"{PAIRS}, {FEATURES}, {SCORED}")
def link_score(spark, d):
    return L.score_pairs(_pairs(spark, d)).select("transaction_id", "access_id", "link_score", "link_gap",
                                                  F.col("link_suspicious").cast("int").alias("link_suspicious"))


DRIVERS = """list_slice(list_filter([
  case when minutes <= 5 then 'Tight temporal link: ' || format('{:.1f}', minutes) || ' mins between access and funds departure' end,
  case when role_match = 0 then 'Role mismatch: ' || role || ' accessed ' || account_type || ' account' end,
  case when z > 2 then 'Anomalous transaction value: INR ' || format('{:,.2f}', amount) || ' (' || format('{:.1f}', z) || 'x baseline)' end,
  case when h < 8 or h > 18 then 'Off-hours internal access at ' || h::int::varchar || ':00' end], lambda x: x is not null), 1, 3)"""


@query("link_drivers", f"select transaction_id, access_id, array_to_string({DRIVERS}, ' | ') as drivers from features", "at", f"{PAIRS}, {FEATURES}")
def link_drivers(spark, d):
    return L.score_pairs(_pairs(spark, d)).select("transaction_id", "access_id", F.array_join("link_drivers", " | ").alias("drivers"))


@query("prior_access_flags", """select t.transaction_id, (exists (select 1 from access_events a where a.account_id = t.account_id
  and a.timestamp <= t.timestamp and a.timestamp >= t.timestamp - interval 10 minutes))::int as has_prior_access from transactions t""", "at")
def prior_access_flags(spark, d):
    return L.prior_access(txns(spark, d), access(spark, d)).select(
        "transaction_id", F.col("has_prior_access").cast("int").alias("has_prior_access"))


@query("buffer_zscore", """select transaction_id, round(case when n > 1 then (amount - m) / case when s > 0 then s else 1 end
  else (amount - 10000) / 15000 end, 6) + 0.0 as amount_zscore from (
  select transaction_id, amount, count(*) over w as n, avg(amount) over w as m, stddev_pop(amount) over w as s from transactions
  window w as (partition by account_id order by timestamp, transaction_id rows between 20 preceding and 1 preceding))""", "t")
def buffer_zscore(spark, d):
    b = ordered_blocks(txns(spark, d), ["account_id"], ["timestamp", "transaction_id"], reach=20)
    past = F.collect_list("amount").over(b.over.rowsBetween(-20, -1))
    return b.finish(b.df.withColumn("_past", past)).select(
        "transaction_id", r(L.history_zscore(F.col("amount"), F.col("_past")), 6, "amount_zscore"))


@query("role_access_map", f"select role, account_type, {allowed()}::int as allowed, count(*) as n_rows from access_events group by all", "a")
def role_access_map(spark, d):
    return access(spark, d).groupBy("role", "account_type").agg(F.count(F.lit(1)).alias("n_rows")).select(
        "role", "account_type", role_allows("role", "account_type").cast("int").alias("allowed"), "n_rows")


@query("account_branch_lookup", """select t.transaction_id, coalesce(m.branch, 'BR_001') as home_branch from transactions t left join (
  select account_id, branch_code as branch from (select account_id, branch_code, row_number() over (partition by account_id order by count(*) desc, branch_code) as n
    from access_events group by account_id, branch_code) where n = 1) m using (account_id)""", "at")
def account_branch_lookup(spark, d):
    home = group_mode(access(spark, d), ["account_id"], "branch_code", "home_branch")
    return L.with_dimension(txns(spark, d).select("transaction_id", "account_id"), home, ["account_id"], {"home_branch": "BR_001"}).drop("account_id")


@query("typed_bursts", """select transaction_id, count(*) filter (where amount < 50000) over w as n_below, count(*) filter (where amount >= 50000) over w as n_above
  from transactions window w as (partition by account_id order by timestamp, transaction_id rows between 19 preceding and current row)""", "t")
def typed_bursts(spark, d):
    b = ordered_blocks(txns(spark, d), ["account_id"], ["timestamp", "transaction_id"], reach=19)
    w = b.over.rowsBetween(-19, 0)
    return b.finish(b.df.withColumn("n_below", F.count_if(F.col("amount") < C.REPORTING_LIMIT).over(w))
                    .withColumn("n_above", F.count_if(F.col("amount") >= C.REPORTING_LIMIT).over(w))).select("transaction_id", "n_below", "n_above")


@query("squashed_scores", """select transaction_id, access_id, round(1 / (1 + exp(-5 * (amount - 10000) / 150000)), 6) as squashed,
  (1 / (1 + exp(-5 * (amount - 10000) / 150000)) > 0.5 or gap_seconds <= 240)::int as suspicious from pairs""", "at", PAIRS)
def squashed_scores(spark, d):
    """A fitted detector's raw score, here the amount's distance from the baseline, squashed into (0, 1) and judged."""
    rows = L.link_features(L.temporal_link(access(spark, d), txns(spark, d))).withColumn("raw", (F.col("amount") - 10000.0) / 150000.0)
    scored = L.link_score(rows.withColumn("squashed", squash("raw")), "raw")
    return scored.select("transaction_id", "access_id", r("squashed", 6), F.col("link_suspicious").cast("int").alias("suspicious"))
