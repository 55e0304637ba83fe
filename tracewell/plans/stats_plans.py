"""Aggregates, rates, histograms, quantiles, splits of the data by type, and data checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell import constants as C
from tracewell.operators import quality as Q
from tracewell.operators import sketches as SK
from tracewell.operators import stats as S
from tracewell.plans.registry import access, ledger, query, r, txns, us
from tracewell.session import checkpointed
from tracewell.sources.readers import scored_types


@query("account_stats", """select account_id, round(avg(amount), 4) as mean_amount, round(stddev_samp(amount), 4) as std_amount, max(amount) as max_amount,
  count(*) as n_rows from transactions group by account_id""", "t")
def account_stats(spark, d):
    return S.group_stats(txns(spark, d), ["account_id"], "amount").select(
        "account_id", r("mean_amount"), r("std_amount"), "max_amount", "n_rows")


@query("amount_zscore", """select transaction_id, round((amount - avg(amount) over w) / nullif(coalesce(stddev_samp(amount) over w, 1), 0), 6) + 0.0 as amount_zscore
  from transactions window w as (partition by account_id)""", "t")
def amount_zscore(spark, d):
    return S.zscore(txns(spark, d), ["account_id"], "amount").select("transaction_id", r("amount_zscore", 6))


@query("records_zscore", """select event_id, round((records_accessed - avg(records_accessed) over w) / nullif(coalesce(stddev_samp(records_accessed) over w, 1), 0), 6) + 0.0
  as records_accessed_zscore from access_events window w as (partition by employee_id)""", "a")
def records_zscore(spark, d):
    return S.zscore(access(spark, d), ["employee_id"], "records_accessed").select("event_id", r("records_accessed_zscore", 6))


@query("branch_mode", """select account_id, branch_code as branch_code_mode from (select account_id, branch_code,
  row_number() over (partition by account_id order by count(*) desc, branch_code) as n from access_events group by account_id, branch_code) where n = 1""", "a")
def branch_mode(spark, d):
    return S.group_mode(access(spark, d), ["account_id"], "branch_code")


@query("action_rarity", """select role, action_type, round(1 - count(*) / sum(count(*)) over (partition by role), 6) as action_type_rarity
  from access_events group by role, action_type""", "a")
def action_rarity(spark, d):
    return S.rarity(access(spark, d), "role", "action_type").select("role", "action_type", r("action_type_rarity", 6))


@query("value_counts", "select scenario, count(*) as n_rows, round(count(*) / sum(count(*)) over (), 6) as share from transactions group by scenario", "t")
def value_counts(spark, d):
    return S.value_counts(txns(spark, d), ["scenario"], normalize=True).select("scenario", "n_rows", r("share", 6))


@query("category_share", "select role, count(*) as n_rows, round(count(*) / sum(count(*)) over (), 6) as share from access_events group by role", "a")
def category_share(spark, d):
    return S.shares(access(spark, d), "role").select("role", "n_rows", r("share", 6))


@query("fraud_scenarios", "select scenario, count(*) as n_rows from transactions where is_fraud = 1 group by scenario", "t")
def fraud_scenarios(spark, d):
    return S.value_counts(txns(spark, d).where(F.col("is_fraud") == 1), ["scenario"])


@query("distinct_profile", """select count(*) as n_rows, epoch_us(min(timestamp)) as min_us, epoch_us(max(timestamp)) as max_us, count(distinct account_id) as n_account_id,
  count(distinct counterparty_id) as n_counterparty_id from transactions""", "t")
def distinct_profile(spark, d):
    return S.profile(txns(spark, d), "timestamp", ["account_id", "counterparty_id"]).select(
        "n_rows", us("min_ts", "min_us"), us("max_ts", "max_us"), "n_account_id", "n_counterparty_id")


@query("distinct_roles", "select distinct role from access_events", "a")
def distinct_roles(spark, d):
    return access(spark, d).select("role").distinct()


@query("account_overlap", """select count(*) as n_union, sum(a)::bigint as n_left, sum(t)::bigint as n_right, count(*) filter (where a = 1 and t = 0) as n_left_only,
  count(*) filter (where a = 0 and t = 1) as n_right_only from (select account_id, max(a) as a, max(t) as t from (
  select account_id, 1 as a, 0 as t from access_events union all select account_id, 0, 1 from transactions) group by account_id)""", "at")
def account_overlap(spark, d):
    return S.distinct_overlap(access(spark, d), txns(spark, d), "account_id")


@query("null_counts", f"select {', '.join(f'count(*) filter (where {c} is null) as {c}' for c in ['transaction_id', 'account_id', 'amount', 'counterparty_id', 'branch_code', 'scenario'])} from transactions", "t")
def null_counts(spark, d):
    return S.null_counts(txns(spark, d).select("transaction_id", "account_id", "amount", "counterparty_id", "branch_code", "scenario"))


@query("label_rates", """select type, count(*) as n_rows, sum(isfraud)::bigint as n_positive, round(avg(isfraud) * 100, 6) as rate_pct from ledger group by type""", "l")
def label_rates(spark, d):
    return S.label_rates(ledger(spark, d), "isfraud", ["type"]).select("type", "n_rows", "n_positive", r("rate_pct", 6))


@query("daily_counts", """select strftime(d.day, '%Y-%m-%d') as day, count(t.transaction_id) as n_rows, count(*) filter (where t.is_fraud = 1) as n_positive
  from (select unnest(generate_series(min(timestamp)::date::timestamp, max(timestamp)::date::timestamp, interval 1 day)) as day from transactions) d
  left join transactions t on t.timestamp::date = d.day::date group by d.day""", "t")
def daily_counts(spark, d):
    return S.daily_counts(txns(spark, d), "timestamp", "is_fraud").select(F.col("day").cast("string").alias("day"), "n_rows", "n_positive")


@query("ledger_daily_counts", """select strftime(d.day, '%Y-%m-%d') as day, count(t.txn_key) as n_rows, count(*) filter (where t.isfraud = 1) as n_positive
  from (select unnest(generate_series(min(timestamp)::date::timestamp, max(timestamp)::date::timestamp, interval 1 day)) as day from ledger) d
  left join ledger t on t.timestamp::date = d.day::date group by d.day""", "l")
def ledger_daily_counts(spark, d):
    return S.daily_counts(ledger(spark, d), "timestamp", "isfraud").select(F.col("day").cast("string").alias("day"), "n_rows", "n_positive")


@query("hour_counts", "select hour(timestamp)::int as hour, count(*) as n_rows from transactions group by 1", "t")
def hour_counts(spark, d):
    return S.hour_counts(txns(spark, d), "timestamp")


@query("hour_role_pivot", f"select hour(timestamp)::int as hour, {', '.join(f'''count(*) filter (where role = '{x}') as {x}''' for x in C.ROLES)} from access_events group by 1", "a")
def hour_role_pivot(spark, d):
    return S.hour_pivot(access(spark, d), "timestamp", "role", C.ROLES)


@query("scenario_median", "select scenario, round(quantile_cont(amount, 0.5), 4) as median_amount from transactions group by scenario", "t")
def scenario_median(spark, d):
    return S.quantiles(txns(spark, d), ["scenario"], "amount", {"median_amount": 0.5}).select("scenario", r("median_amount"))


@query("role_quartiles", """select role, round(quantile_cont(records_accessed::double, 0.25), 4) as q25, round(quantile_cont(records_accessed::double, 0.5), 4) as q50,
  round(quantile_cont(records_accessed::double, 0.75), 4) as q75 from access_events group by role""", "a")
def role_quartiles(spark, d):
    return S.quantiles(access(spark, d), ["role"], "records_accessed", {"q25": 0.25, "q50": 0.5, "q75": 0.75}).select("role", r("q25"), r("q50"), r("q75"))


def _bins(x: str, n: int, source: str, by: str) -> str:
    return f"""select {by}, coalesce(least(floor((x - lo) / ((hi - lo) / {n})), {n} - 1), 0)::int as bin, count(*) as n_rows from (
  select {by}, {x} as x, min({x}) over () as lo, max({x}) over () as hi from {source}) group by all"""


@query("amount_histogram", _bins("amount", 50, "transactions", "is_fraud"), "t")
def amount_histogram(spark, d):
    return S.histogram(txns(spark, d), "amount", 50, by=["is_fraud"]).select("is_fraud", "bin", "n_rows")


@query("amount_histogram_log", _bins("log10(amount)", 50, "ledger", "isfraud"), "l")
def amount_histogram_log(spark, d):
    return S.histogram(ledger(spark, d), "amount", 50, log=True, by=["isfraud"]).select("isfraud", "bin", "n_rows")


@query("amount_density", """select bin, round(lo + bin * w, 4) as bin_start, round(n_rows / (sum(n_rows) over () * w), 12) as density from (
  select least(floor((amount - lo) / ((hi - lo) / 40)), 39)::int as bin, count(*) as n_rows, any_value(lo) as lo, any_value((hi - lo) / 40) as w from (
  select amount, min(amount) over () as lo, max(amount) over () as hi from transactions) group by 1)""", "t")
def amount_density(spark, d):
    return S.histogram(txns(spark, d), "amount", 40, density=True).select("bin", r("bin_start"), r("density", 12))


_DESCRIBED = ["amount", "oldbalanceorg", "newbalanceorg", "oldbalancedest", "newbalancedest"]


@query("describe", " union all ".join(f"""select '{c}' as feature, count({c}) as n_rows, round(avg({c}), 3) as mean, round(stddev_samp({c}), 3) as std, round(min({c}), 3) as min,
  round(quantile_cont({c}, 0.25), 3) as q25, round(quantile_cont({c}, 0.5), 3) as q50, round(quantile_cont({c}, 0.75), 3) as q75, round(max({c}), 3) as max from ledger""" for c in _DESCRIBED), "l")
def describe(spark, d):
    out = S.describe(ledger(spark, d), _DESCRIBED)
    return out.select("feature", "n_rows", *[r(c, 3) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")])


@query("corr_with_label", " union all ".join(f"select '{c}' as feature, round(corr({c}, isfraud), 6) + 0.0 as corr from ledger" for c in _DESCRIBED), "l")
def corr_with_label(spark, d):
    return S.corr_with_label(ledger(spark, d), _DESCRIBED, "isfraud").select("feature", r("corr", 6))


@query("corr_matrix", " union all ".join(f"select '{a}' as feature_a, '{b}' as feature_b, round(corr({a}, {b}), 6) + 0.0 as corr from ledger" for a in _DESCRIBED for b in _DESCRIBED), "l")
def corr_matrix(spark, d):
    return S.corr_matrix(ledger(spark, d), _DESCRIBED).select("feature_a", "feature_b", r("corr", 6))


_GAPPED = ["records_accessed", "hour_of_day", "day_of_week"]


@query("mean_abs_diff", " union all ".join(f"select '{n}' as feature, round(abs(avg({e}) filter (where is_suspicious = 1) - avg({e}) filter (where is_suspicious = 0)), 6) as mean_abs_diff from access_events"
                                           for n, e in zip(_GAPPED, ["records_accessed", "hour(timestamp)", "isodow(timestamp) - 1"])), "a")
def mean_abs_diff(spark, d):
    rows = access(spark, d).withColumns({"hour_of_day": F.hour("timestamp"), "day_of_week": F.weekday("timestamp")})
    return S.mean_gap(rows, _GAPPED, "is_suspicious").select("feature", r("mean_abs_diff", 6))


@query("score_percentiles", """select min(amount) as min, max(amount) as max, round(avg(amount), 4) as mean, round(quantile_cont(amount, 0.5), 4) as median,
  round(quantile_cont(amount, 0.95), 4) as p95, round(quantile_cont(amount, 0.99), 4) as p99 from transactions""", "t")
def score_percentiles(spark, d):
    return S.score_quantiles(txns(spark, d), "amount").select("min", "max", r("mean"), r("median"), r("p95"), r("p99"))


@query("imbalance", """select count(*) filter (where isfraud = 0) as n_negative, count(*) filter (where isfraud = 1) as n_positive,
  round(count(*) filter (where isfraud = 0) / greatest(1, count(*) filter (where isfraud = 1)), 6) as negatives_per_positive from ledger""", "l")
def imbalance(spark, d):
    return S.imbalance(ledger(spark, d), "isfraud").select("n_negative", "n_positive", r("negatives_per_positive", 6))


@query("minmax_global", """select transaction_id, round((amount - min(amount) over ()) / (max(amount) over () - min(amount) over ()), 8) as amount_norm from transactions""", "t")
def minmax_global(spark, d):
    return S.minmax(txns(spark, d), "amount").select("transaction_id", r("amount_norm", 8))


@query("minmax_by_role", """select event_id, round((records_accessed - min(records_accessed) over w) / (max(records_accessed) over w - min(records_accessed) over w + 1e-9), 8)
  as records_norm from access_events window w as (partition by role)""", "a")
def minmax_by_role(spark, d):
    return S.minmax(access(spark, d), "records_accessed", by=["role"], name="records_norm").select("event_id", r("records_norm", 8))


@query("active_accounts", """select txn_key, account_id from ledger where type in ('TRANSFER', 'CASH_OUT') and account_id in (
  select account_id from ledger where type in ('TRANSFER', 'CASH_OUT') group by account_id having count(*) >= 3)""", "l")
def active_accounts(spark, d):
    return S.keep_active(scored_types(ledger(spark, d)), "account_id", 3).select("txn_key", "account_id")


@query("busiest_accounts", """select transaction_id, account_id from transactions where account_id in (
  select account_id from transactions group by account_id having count(*) >= 2 order by count(*) desc, account_id limit 10)""", "t")
def busiest_accounts(spark, d):
    return S.keep_active(txns(spark, d), "account_id", 2, top=10).select("transaction_id", "account_id")


@query("unmatched_accounts", "select distinct account_id from ledger where account_id not in (select 'C' || lpad(right(account_id, 5)::int::varchar, 9, '0') from access_events)", "al")
def unmatched_accounts(spark, d):
    known = access(spark, d).withColumn("account_id", F.concat(F.lit("C"), F.lpad(F.right("account_id", F.lit(5)).cast("int").cast("string"), 9, "0")))
    return Q.unmatched(ledger(spark, d), known)


@query("unmatched_check", """select count(distinct t.account_id) as n_accounts, count(distinct t.account_id) filter (where a.account_id is null) as n_unmatched,
  case when count(*) filter (where a.account_id is null) = 0 then 'PASS' else 'WARNING' end as status
  from transactions t left join (select distinct account_id from access_events) a using (account_id)""", "at")
def unmatched_check(spark, d):
    return Q.unmatched_check(txns(spark, d), access(spark, d))


_RATE = "count(*) as n_rows, sum({l})::bigint as n_positive, round(avg({l}) * 100, 6) as rate_pct, case when avg({l}) * 100 between {lo} and {hi} then 'PASS' else 'WARNING' end as status"


@query("rate_checks", f"""select 'transactions' as source, {_RATE.format(l='is_fraud', lo=3, hi=8)} from transactions union all
  select 'access', {_RATE.format(l='is_suspicious', lo=0, hi=100)} from access_events union all
  select 'ledger', {_RATE.format(l='isfraud', lo=0.05, hi=2)} from ledger""", "atl")
def rate_checks(spark, d):
    checks = {"transactions": Q.rate_check(txns(spark, d), "is_fraud", 3.0, 8.0), "access": Q.rate_check(access(spark, d), "is_suspicious", 0.0, 100.0),
              "ledger": Q.rate_check(ledger(spark, d), "isfraud", 0.05, 2.0)}
    out = None
    for name, row in checks.items():
        row = row.select(F.lit(name).alias("source"), "n_rows", "n_positive", r("rate_pct", 6), "status")
        out = row if out is None else out.unionByName(row)
    return out


@query("domain_checks", """select 'missing_type' as kind, v as value from (values ('CASH_IN'), ('CASH_OUT'), ('DEBIT'), ('PAYMENT'), ('TRANSFER')) w(v)
  where v not in (select type from ledger) union all select distinct 'unexpected_role', role from access_events where role not in ('loan_officer', 'branch_manager')""", "al")
def domain_checks(spark, d):
    missing = Q.domain_check(ledger(spark, d), "type", C.LEDGER_TYPES, subset=True)
    odd = Q.domain_check(access(spark, d), "role", ["loan_officer", "branch_manager"])
    return missing.select(F.lit("missing_type").alias("kind"), "value").union(odd.select(F.lit("unexpected_role"), "value"))


@query("negative_amounts", "select count(*) filter (where amount < 0) as n_negative, case when count(*) filter (where amount < 0) = 0 then 'PASS' else 'WARNING' end as status from transactions", "t")
def negative_amounts(spark, d):
    return Q.amount_check(txns(spark, d))


@query("structuring_size", "select count(*) filter (where scenario = 'structuring') as n_rows, case when count(*) filter (where scenario = 'structuring') >= 50 then 'PASS' else 'WARNING' end as status from transactions", "t")
def structuring_size(spark, d):
    return Q.scenario_size_check(txns(spark, d))


@query("prior_access_check", """select count(*) filter (where m) as n_matched, count(*) as n_total, case when count(*) filter (where m) = count(*) then 'PASS' else 'WARNING' end as status from (
  select exists (select 1 from access_events a where a.account_id = t.account_id and a.timestamp <= t.timestamp and a.timestamp >= t.timestamp - interval 10 minutes) as m
  from transactions t where scenario = 'temporal_link')""", "at")
def prior_access_check(spark, d):
    return Q.prior_access_check(txns(spark, d), access(spark, d))


@query("early_txns", "select transaction_id from transactions where timestamp < (select min(timestamp) from access_events where is_suspicious = 1)", "at")
def early_txns(spark, d):
    return Q.early_rows(txns(spark, d), access(spark, d).where(F.col("is_suspicious") == 1)).select("transaction_id")


_DAYS = ("2024-01-05", "2024-01-20")
_RANGE = f"cast(timestamp as date) between date '{_DAYS[0]}' and date '{_DAYS[1]}'"


@query("sketch_quantiles", f"""select scenario, share, quantile_disc(amount, 0.5) filter (where share = 0.5) as q50, quantile_disc(amount, 0.95) filter (where share = 0.95) as q95, true as within_bound
  from transactions, (values (0.5), (0.95)) s(share) where {_RANGE} group by scenario, share""", "t")
def sketch_quantiles(spark, d):
    """Quantiles of a range of days, merged from the stored sketches of its days; beside them the exact ones."""
    rows = txns(spark, d)
    found = SK.quantiles(checkpointed(SK.daily_values(rows, ["scenario"], "amount")), ["scenario"], [0.5, 0.95], *_DAYS)
    days = rows.where(F.to_date("timestamp").between(F.lit(_DAYS[0]).cast("date"), F.lit(_DAYS[1]).cast("date")))
    exact = days.groupBy("scenario").agg(*[F.expr(f"percentile_disc({q}) within group (order by amount)").alias(f"e{k}") for k, q in enumerate((0.5, 0.95))])
    true = F.when(F.col("share") == 0.5, F.col("e0")).otherwise(F.col("e1"))
    return found.join(exact, "scenario").select("scenario", "share", F.when(F.col("share") == 0.5, F.col("e0")).alias("q50"), F.when(F.col("share") == 0.95, F.col("e1")).alias("q95"),
                                                (F.abs(F.col("value") - true) <= SK.ALPHA * F.abs(true) * (1 + 1e-9)).alias("within_bound"))


@query("sketch_distinct", f"select scenario, count(distinct account_id) as n_accounts, true as within_bound from transactions where {_RANGE} group by scenario", "t")
def sketch_distinct(spark, d):
    """Distinct accounts of a range of days, merged from the stored sketches of its days; beside them the exact count."""
    rows = txns(spark, d)
    found = SK.distinct(checkpointed(SK.daily_distinct(rows, ["scenario"], "account_id")), ["scenario"], *_DAYS)
    days = rows.where(F.to_date("timestamp").between(F.lit(_DAYS[0]).cast("date"), F.lit(_DAYS[1]).cast("date")))
    exact = days.groupBy("scenario").agg(F.countDistinct("account_id").alias("n_accounts"))
    return found.join(exact, "scenario").select("scenario", "n_accounts", (F.abs(F.col("n_distinct") - F.col("n_accounts")) <= SK.DISTINCT_ERROR * F.col("n_accounts") + 1).alias("within_bound"))
