"""Window queries over each account's own history, bursts, roles and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell import constants as C
from tracewell.operators import history as H
from tracewell.operators import profile as P
from tracewell.operators import roles as R
from tracewell.operators import structuring as B
from tracewell.plans.link_plans import type_code
from tracewell.plans.registry import BURST_HOURS, SQL, access, ledger, query, r, txns, us

BURST_S = BURST_HOURS * 3600
W = "partition by account_id order by timestamp, transaction_id"
WL = "partition by account_id order by timestamp, txn_key"
GAP = "least(coalesce((epoch_us(timestamp) - epoch_us(lag(timestamp) over w)) / 6e7, 9999), 10000)"
GAPS = f"gaps as (select *, {GAP} as gap, case when amount >= 30000 and amount < 50000 then 1 else 0 end as band, case when {GAP} <= 120 then 1 else 0 end as fast from transactions window w as ({W}))"


@query("txn_gaps", "select transaction_id, gap as time_since_last_minutes from gaps", "t", GAPS)
def txn_gaps(spark, d):
    return H.txn_gaps(txns(spark, d)).select("transaction_id", "time_since_last_minutes")


@query("step_gaps", f"""select txn_key, least(coalesce((epoch_us(timestamp) - epoch_us(lag(timestamp) over w)) / 3.6e9, 0), 100) as time_since_last_steps
  from ledger window w as ({WL})""", "l")
def step_gaps(spark, d):
    return H.step_gaps(ledger(spark, d)).select("txn_key", "time_since_last_steps")


@query("rolling3", f"""select transaction_id, round(sum(amount) over w3, 2) as cumulative_amount_window, (sum(band) over w3)::double as roll_struct_band_3,
  (sum(fast) over w3)::double as roll_fast_3 from gaps window w3 as ({W} rows between 2 preceding and current row)""", "t", GAPS)
def rolling3(spark, d):
    return H.rolling(txns(spark, d)).select("transaction_id", r("cumulative_amount_window", 2), "roll_struct_band_3", "roll_fast_3")


@query("velocity5", f"""select transaction_id, (sum(fast) over w5)::double as velocity_count, (count(*) over w3)::double as rolling_velocity_3
  from gaps window w5 as ({W} rows between 4 preceding and current row), w3 as ({W} rows between 2 preceding and current row)""", "t", GAPS)
def velocity5(spark, d):
    return H.velocity(txns(spark, d)).select("transaction_id", "velocity_count", "rolling_velocity_3")


HOMOGENEITY = "least(greatest(coalesce(stddev_samp(amount) over w3 / (avg(amount) over w3 + 1), 0), 0), 5)"


@query("homogeneity", f"select transaction_id, round({HOMOGENEITY}, 6) as amount_homogeneity from transactions window w3 as ({W} rows between 2 preceding and current row)", "t")
def homogeneity(spark, d):
    return H.homogeneity(txns(spark, d)).select("transaction_id", r("amount_homogeneity", 6))


@query("normalised_amount", "select transaction_id, round(amount / (avg(amount) over (partition by account_id) + 1), 6) as amount_normalised from transactions", "t")
def normalised_amount(spark, d):
    return H.normalised_amount(txns(spark, d)).select("transaction_id", r("amount_normalised", 6))


@query("expanding_history", f"""select transaction_id, (row_number() over w - 1)::double as historical_txn_count, round(coalesce(avg(amount) over p, 0), 4) as historical_mean_amount,
  round(coalesce(stddev_samp(amount) over p, 0), 4) as historical_std_amount, coalesce(max(amount) over p, 0) as historical_max_amount
  from transactions window w as ({W}), p as ({W} rows between unbounded preceding and 1 preceding)""", "t")
def expanding_history(spark, d):
    return H.past_stats(txns(spark, d)).select("transaction_id", "historical_txn_count", r("historical_mean_amount"), r("historical_std_amount"), "historical_max_amount")


@query("daily_access_count", "select event_id, row_number() over (partition by employee_id, timestamp::date order by timestamp, event_id) - 1 as past_count from access_events", "a")
def daily_access_count(spark, d):
    rows = access(spark, d).withColumn("_day", F.to_date("timestamp"))
    return H.past_count(rows, ["employee_id", "_day"]).select("event_id", "past_count")


@query("dormancy", f"""select transaction_id, days as days_since_last_transaction, (days > 30)::int::double as is_dormant_account from (
  select transaction_id, coalesce((epoch_us(timestamp) - epoch_us(lag(timestamp) over w)) / 1e6 / 86400, 999) as days from transactions window w as ({W}))""", "t")
def dormancy(spark, d):
    return H.dormancy(txns(spark, d)).select("transaction_id", "days_since_last_transaction", "is_dormant_account")


@query("account_age", "select transaction_id, (epoch_us(timestamp) - epoch_us(min(timestamp) over (partition by account_id))) / 1e6 / 3600 as account_age_steps from transactions", "t")
def account_age(spark, d):
    return H.account_age(txns(spark, d)).select("transaction_id", "account_age_steps")


@query("new_counterparty", "select transaction_id, (row_number() over (partition by account_id, counterparty_id order by timestamp, transaction_id) = 1)::int::double as is_new_counterparty from transactions", "t")
def new_counterparty(spark, d):
    return H.new_counterparty(txns(spark, d)).select("transaction_id", "is_new_counterparty")


@query("type_match", f"select txn_key, coalesce(type = lag(type) over w, false)::int::double as type_matches_history from ledger window w as ({WL})", "l")
def type_match(spark, d):
    return H.type_matches(ledger(spark, d)).select("txn_key", "type_matches_history")


@query("last_n", "select transaction_id, recency from (select transaction_id, row_number() over (partition by account_id order by timestamp desc, transaction_id desc) as recency from transactions) where recency <= 20", "t")
def last_n(spark, d):
    return H.last_n(txns(spark, d)).select("transaction_id", "recency")


@query("last_access", "select account_id, event_id, employee_id from (select *, row_number() over (partition by account_id order by timestamp desc, event_id desc) as n from access_events) where n = 1", "a")
def last_access(spark, d):
    return H.last_access(access(spark, d)).select("account_id", "event_id", "employee_id")


LABEL = f"""ends as (select *, (count(*) over b >= 3 and max(amount) over b < 50000 and sum(amount) over b >= 75000)::int as ends_burst from transactions
  window b as (partition by account_id order by timestamp range between interval {BURST_HOURS} hours preceding and current row)),
  labelled as (select *, max(ends_burst) over (partition by account_id order by timestamp range between current row and interval {BURST_HOURS} hours following) as is_structuring from ends)"""


@query("structuring_label", "select transaction_id, ends_burst, is_structuring from labelled", "t", LABEL)
def structuring_label(spark, d):
    return B.label_bursts(txns(spark, d), BURST_S).select("transaction_id", "ends_burst", "is_structuring")


RULE = f"""placed as (select *, row_number() over ({W}) as n from transactions),
  cluster as (select t.transaction_id, o.transaction_id as member_id, o.amount as member_amount, o.timestamp as member_ts
    from placed t join placed o on o.account_id = t.account_id and o.n between t.n - 19 and t.n and o.timestamp >= t.timestamp - interval {BURST_HOURS} hours and o.amount < 50000),
  rule as (select t.transaction_id, count(c.member_id) as cluster_count, round(coalesce(sum(c.member_amount), 0), 2) as aggregate_amount,
    (count(c.member_id) >= 3 and coalesce(sum(c.member_amount), 0) >= 75000) as matched from transactions t left join cluster c using (transaction_id) group by t.transaction_id)"""


@query("structuring_rule", """select transaction_id, cluster_count::int as cluster_count, aggregate_amount, matched::int as rule_matched,
  case when matched then 0.9::double else 0.1::double end as burst_score from rule""", "t", RULE)
def structuring_rule(spark, d):
    return B.burst_result(txns(spark, d), window_s=BURST_S).select(
        "transaction_id", "cluster_count", "aggregate_amount", F.col("rule_matched").cast("int").alias("rule_matched"), "burst_score")


@query("structuring_cluster", "select c.transaction_id, c.member_id, c.member_amount, epoch_us(c.member_ts) as member_us from cluster c join rule r using (transaction_id) where r.matched", "t", RULE)
def structuring_cluster(spark, d):
    rows = B.burst_rule(txns(spark, d), BURST_S).where("rule_matched").select("transaction_id", F.explode("cluster_rows").alias("c"))
    return rows.select("transaction_id", F.col("c.transaction_id").alias("member_id"), F.col("c.amount").alias("member_amount"), us(F.col("c.timestamp"), "member_us"))


@query("structuring_evidence", f"""select transaction_id, 'Detected ' || cluster_count || ' rapid transfers in a {BURST_HOURS}.0-hour window, each below mandatory reporting threshold of INR 50,000. Combined laundered value: INR '
  || format('{{:,.2f}}', aggregate_amount) || '.' as evidence from rule where matched""", "t", RULE)
def structuring_evidence(spark, d):
    return B.burst_result(txns(spark, d), window_s=BURST_S).where("rule_matched").select("transaction_id", F.col("burst_evidence").alias("evidence"))


SEQUENCE = f"""sequences as (select transaction_id, timestamp, account_id, round(amount / (avg(amount) over (partition by account_id) + 1), 6) as amount_normalised, gap as time_since_last_minutes,
  (amount < 50000)::int::double as is_below_threshold, band::double as is_struct_band, (transaction_type = 'TRANSFER')::int::double as is_transfer, fast::double as is_fast,
  (sum(fast) over w3)::double as roll_fast_3, (sum(band) over w3)::double as roll_struct_band_3, round(sum(amount) over w3, 2) as cumulative_amount_window,
  round({HOMOGENEITY}, 6) as amount_homogeneity, (sum(fast) over w5)::double as velocity_count,
  round(least(greatest((greatest(0, 100000 - amount) - 100000) / 100001::double, -10), 10), 6) + 0.0 as balance_change_ratio
  from gaps window w3 as ({W} rows between 2 preceding and current row), w5 as ({W} rows between 4 preceding and current row))"""


@query("sequence_features", f"select transaction_id, {', '.join(C.BURST_FEATURES)} from sequences", "t", f"{GAPS}, {SEQUENCE}")
def sequence_features(spark, d):
    return B.sequence_features(txns(spark, d)).select("transaction_id", *[F.col(c) if c == "time_since_last_minutes" else r(c, 2 if c == "cumulative_amount_window" else 6) for c in C.BURST_FEATURES])


@query("loader_sequence_features", f"""select txn_key, round(amount / (avg(amount) over (partition by account_id) + 1), 6) as amount_norm,
  least(coalesce((epoch_us(timestamp) - epoch_us(lag(timestamp) over w)) / 3.6e9, 0), 100) as time_since_last_steps, (amount < 50000)::int::double as is_below_threshold,
  (amount >= 30000 and amount < 50000)::int::double as is_struct_band, (type = 'TRANSFER')::int::double as is_transfer,
  (count(*) over ({WL} rows between 2 preceding and current row))::double as rolling_velocity_3,
  round(least(greatest((newbalanceorg - oldbalanceorg) / (oldbalanceorg + 1), -10), 10), 6) + 0.0 as balance_change_ratio from ledger window w as ({WL})""", "l")
def loader_sequence_features(spark, d):
    return B.loader_sequence_features(ledger(spark, d)).select("txn_key", *[r(c, 6) for c in C.LOADER_SEQUENCE_FEATURES])


@query("sequence_emit", f"""select transaction_id, is_structuring from (select *, row_number() over ({W}) - 1 as i, count(*) over (partition by account_id) as n from labelled)
  where is_structuring = 1 or i % 2 = 0 or i = n - 1""", "t", LABEL)
def sequence_emit(spark, d):
    return B.emit_rows(B.label_bursts(txns(spark, d), BURST_S)).where("emitted").select("transaction_id", "is_structuring")


@query("sequence_tensor", "select transaction_id, " + ", ".join(f"coalesce(lag(amount, {4 - i}) over w, 0) as amount_{i}, coalesce(lag((amount < 50000)::int, {4 - i}) over w, 0)::double as below_{i}" for i in range(5))
       + f" from transactions window w as ({W})", "t")
def sequence_tensor(spark, d):
    rows = txns(spark, d).withColumn("below", (F.col("amount") < C.REPORTING_LIMIT).cast("double"))
    seq = B.sequence_tensor(rows, ["amount", "below"], 5)
    at = lambda i, j: F.col("sequence")[i][j]
    return seq.select("transaction_id", *[at(i, 0).alias(f"amount_{i}") for i in range(5)], *[at(i, 1).alias(f"below_{i}") for i in range(5)])


# Long sequences are shown as one sum per feature, each step weighted by its place, so that values and places both count.
_STEP_PLACES = {"time_since_last_minutes": 3, "time_since_last_steps": 3, "cumulative_amount_window": 2}


def _weighted(seq: str, j: int, name: str):
    total = F.aggregate(F.transform(seq, lambda v, i: (i + 1) * v[j]), F.lit(0.0), lambda a, x: a + x)
    return r(total, _STEP_PLACES.get(name, 6), name)


@query("sequence_tensor_full", "select transaction_id, " + ", ".join(f"round(coalesce(sum(n * {c}) over f - (n - 30) * sum({c}) over f, 0), {_STEP_PLACES.get(c, 6)}) + 0.0 as {c}" for c in C.BURST_FEATURES)
       + f" from (select *, row_number() over ({W}) as n from sequences) window f as ({W} rows between 29 preceding and current row)", "t", f"{GAPS}, {SEQUENCE}")
def sequence_tensor_full(spark, d):
    rows = B.sequence_features(txns(spark, d))
    rows = rows.withColumns({c: r(c, 2 if c == "cumulative_amount_window" else 6) for c in C.BURST_FEATURES if c != "time_since_last_minutes"})
    seq = B.sequence_tensor(rows, C.BURST_FEATURES, 30)
    return seq.select("transaction_id", *[_weighted("sequence", j, c) for j, c in enumerate(C.BURST_FEATURES)])


_LOADER = SQL["loader_sequence_features"].split("select txn_key,", 1)[1]


@query("account_sequences_full", "select account_id, " + ", ".join(f"round(sum((21 - k) * {c}) filter (where k <= 20), {_STEP_PLACES.get(c, 6)}) + 0.0 as {c}" for c in C.LOADER_SEQUENCE_FEATURES)
       + """, max(m) as label from (select *, row_number() over (partition by account_id order by timestamp desc, txn_key desc) as k, max(isfraud) over (partition by account_id) as m from steps) group by account_id""",
       "l", f"steps as (select account_id, timestamp, isfraud, txn_key,{_LOADER})")
def account_sequences_full(spark, d):
    rows = B.loader_sequence_features(ledger(spark, d))
    rows = rows.withColumns({c: r(c, 6) for c in C.LOADER_SEQUENCE_FEATURES if c != "time_since_last_steps"})
    seq = B.account_sequences(rows, C.LOADER_SEQUENCE_FEATURES, "isfraud", 20)
    return seq.select("account_id", *[_weighted("sequence", j, c) for j, c in enumerate(C.LOADER_SEQUENCE_FEATURES)], "label")


@query("account_sequences", "select account_id, " + ", ".join(f"coalesce(max(amount) filter (where k = {5 - i}), 0) as amount_{i}" for i in range(5))
       + """, max(m) as label from (select account_id, amount, row_number() over (partition by account_id order by timestamp desc, txn_key desc) as k,
  max(isfraud) over (partition by account_id) as m from ledger) group by account_id""", "l")
def account_sequences(spark, d):
    seq = B.account_sequences(ledger(spark, d), ["amount"], "isfraud", 5)
    return seq.select("account_id", *[F.col("sequence")[i][0].alias(f"amount_{i}") for i in range(5)], "label")


PROFILE = f"""profiles as (select txn_key, account_id, timestamp, amount as current_amount, type, isfraud, (epoch_us(timestamp) - epoch_us(first_value(timestamp) over w)) / 1e6 / 3600 as account_age_steps,
  coalesce(avg(amount) over p, 0) as mean_raw, coalesce(stddev_samp(amount) over p, 0) as std_raw, (row_number() over w - 1)::double as historical_txn_count,
  coalesce(max(amount) over p, 0) as historical_max_amount, coalesce((epoch_us(timestamp) - epoch_us(lag(timestamp) over w)) / 1e6 / 86400, 999) as days,
  hour(timestamp)::double as hour_of_day, (row_number() over (partition by account_id, counterparty_id order by timestamp, txn_key) = 1)::int::double as is_new_counterparty,
  oldbalanceorg as balance_before, newbalanceorg as balance_after, least(greatest((oldbalanceorg - newbalanceorg) / (oldbalanceorg + 1), -5), 5) as drop_raw,
  (newbalanceorg = 0)::int::double as balance_is_zero_after, coalesce(type = lag(type) over w, false)::int::double as type_matches_history,
  case type when 'CASH_OUT' then 0 when 'TRANSFER' then 1 else {type_code('type', 'profile')} end::double as type_encoded,
  abs(oldbalanceorg - amount - newbalanceorg) as orig_raw, least(greatest(abs(newbalancedest - oldbalancedest - amount), 0), 1e8) as dest_raw, (type = 'TRANSFER')::int::double as is_transfer
  from ledger window w as ({WL}), p as ({WL} rows between unbounded preceding and 1 preceding)),
  shown as (select *, round(mean_raw, 6) as historical_mean_amount, round(std_raw, 4) as historical_std_amount, days as days_since_last_transaction,
  current_amount / (mean_raw + 1) as mean_ratio, round(current_amount / (mean_raw + 1), 6) as amount_vs_historical_mean_ratio,
  round(current_amount / (historical_max_amount + 1), 6) as amount_vs_historical_max_ratio, round(drop_raw, 6) + 0.0 as balance_drop_ratio, (days > 30)::int::double as is_dormant_account,
  round(orig_raw, 4) as errorBalanceOrig, round(dest_raw, 4) as errorBalanceDest from profiles)"""
_PLACES = {"historical_std_amount": 4, "errorBalanceOrig": 4, "errorBalanceDest": 4}
_EXACT = {"account_age_steps", "days_since_last_transaction", "current_amount", "balance_before", "balance_after", "historical_max_amount"}


def _profile(spark, d):
    return P.profile_features(ledger(spark, d))


@query("profile_features", f"select txn_key, {', '.join(C.PROFILE_FEATURES)} from shown", "l", PROFILE)
def profile_features(spark, d):
    return _profile(spark, d).select("txn_key", *[F.col(c) if c in _EXACT else r(c, _PLACES.get(c, 6)) for c in C.PROFILE_FEATURES])


@query("profile_loader", """select txn_key, round(avg(amount) over a, 6) as historical_mean_amount, max(amount) over a as historical_max_amount, (count(*) over a)::double as historical_txn_count,
  round(least(greatest(amount / (avg(amount) over a + 1), 0), 100), 6) as amount_vs_historical_mean_ratio, round(newbalanceorg + amount - oldbalanceorg, 4) + 0.0 as errorBalanceOrig,
  round(oldbalancedest + amount - newbalancedest, 4) + 0.0 as errorBalanceDest, case type when 'TRANSFER' then 4 when 'CASH_OUT' then 1 else 0 end::double as type_encoded
  from ledger window a as (partition by account_id)""", "l")
def profile_loader(spark, d):
    return P.profile_features(ledger(spark, d), "loader").select(
        "txn_key", r("historical_mean_amount", 6), "historical_max_amount", "historical_txn_count", r("amount_vs_historical_mean_ratio", 6),
        r("errorBalanceOrig"), r("errorBalanceDest"), "type_encoded")


@query("profile_placeholder", """select transaction_id, round(amount * 0.2, 4) as historical_mean_amount, round(amount / (amount * 0.2 + 1), 6) as amount_vs_historical_mean_ratio,
  0.15::double as profile_score, 1.0::double as balance_is_zero_after from transactions""", "t")
def profile_placeholder(spark, d):
    rows = P.profile_score(P.profile_features(txns(spark, d), "placeholder"))
    return rows.select("transaction_id", r("historical_mean_amount"), r("amount_vs_historical_mean_ratio", 6), "profile_score", "balance_is_zero_after")


@query("profile_fallback", """select txn_key, case when days > 30 and mean_ratio > 10 then 0.85::double else 0.15::double end as profile_score,
  (days > 30 and mean_ratio > 10)::int as profile_anomalous from shown""", "l", PROFILE)
def profile_fallback(spark, d):
    return P.profile_score(_profile(spark, d)).select("txn_key", "profile_score", F.col("profile_anomalous").cast("int").alias("profile_anomalous"))


@query("profile_reasons", f"""select txn_key, reason[1] as feature, reason[2]::double as shap_contribution, reason[3] as explanation from (select txn_key, unnest(list_filter([
  case when days > 30 then ['is_dormant_account', '0.42', '{C.PROFILE_REASONS['is_dormant_account']}'] end,
  case when mean_ratio > 5 then ['amount_vs_historical_mean_ratio', '0.38', '{C.PROFILE_REASONS['amount_vs_historical_mean_ratio'].replace("'", "''")}'] end,
  case when balance_is_zero_after = 1 then ['balance_is_zero_after', '0.25', '{C.PROFILE_REASONS['balance_is_zero_after']}'] end], lambda x: x is not null)) as reason from shown)""", "l", PROFILE)
def profile_reasons(spark, d):
    rows = P.profile_reasons(_profile(spark, d)).select("txn_key", F.explode("profile_reasons").alias("x"))
    return rows.select("txn_key", "x.feature", "x.shap_contribution", "x.explanation")


def _rank(col: str) -> str:
    return f"(dense_rank() over (order by {col}) - 1)::double as {col}_encoded"


ROLE = f"""homes as (select employee_id, branch_code as home from (select employee_id, branch_code, row_number() over (partition by employee_id order by count(*) desc, branch_code) as n
    from access_events group by employee_id, branch_code) where n = 1),
  rarities as (select role, action_type, 1 - count(*) / sum(count(*)) over (partition by role) as rarity from access_events group by role, action_type)"""


@query("role_features", f"""select event_id, hour(timestamp)::double as hour_of_day, (isodow(timestamp) - 1)::double as day_of_week, records_accessed::int as records_accessed, {_rank('action_type')}, {_rank('account_type')},
  {_rank('branch_code')}, (isodow(timestamp) >= 6)::int::double as is_weekend, (hour(timestamp) < 9 or hour(timestamp) > 18)::int::double as is_off_hours,
  round((records_accessed - avg(records_accessed) over e) / nullif(coalesce(stddev_samp(records_accessed) over e, 1), 0), 6) + 0.0 as records_accessed_zscore,
  (row_number() over (partition by employee_id, timestamp::date order by timestamp, event_id))::double as access_frequency_today,
  (branch_code = home)::int::double as same_branch_access, round(rarity, 6) as action_type_rarity
  from access_events join homes using (employee_id) join rarities using (role, action_type) window e as (partition by employee_id)""", "a", ROLE)
def role_features(spark, d):
    rows = R.role_features(access(spark, d))
    rounded = {"records_accessed_zscore", "action_type_rarity"}
    return rows.select("event_id", *[r(c, 6) if c in rounded else F.col(c) for c in C.ROLE_FEATURES])


ROLE_LIMIT = "(case role " + " ".join(f"when '{k}' then {v}" for k, v in C.ROLE_THRESHOLDS.items()) + " else 0.05 end)::double"
ROLE_ERROR = "(case when hour(timestamp) < 8 or hour(timestamp) > 18 then 0.12 else 0.02 end)::double"


@query("role_fallback", f"""select event_id, {ROLE_ERROR} as role_error, round({ROLE_LIMIT}, 5) as role_threshold, ({ROLE_ERROR} > {ROLE_LIMIT})::int as role_anomalous,
  round(least(1, {ROLE_ERROR} / greatest(0.01, round({ROLE_LIMIT}, 5))), 6) as role_component from access_events""", "a")
def role_fallback(spark, d):
    rows = R.role_score(access(spark, d))
    return rows.select("event_id", "role_error", r("role_threshold", 5), F.col("role_anomalous").cast("int").alias("role_anomalous"), r("role_component", 6))


@query("role_drivers", """select event_id, 'action_type_rarity (val: ' || case when action_type = 'override' then '0.8' else '0.1' end || ', error: 0.000) | same_branch_access (val: 1.0, error: 0.000) | access_frequency_today (val: 3.0, error: 0.000)'
  as drivers from access_events""", "a")
def role_drivers(spark, d):
    return R.unusual_features(R.serving_features(access(spark, d))).select("event_id", F.array_join("role_drivers", " | ").alias("drivers"))


@query("label_codes", f"select distinct account_type, {_rank('account_type')} from access_events", "a")
def label_codes(spark, d):
    return R.label_codes(access(spark, d), "account_type")


@query("structuring_totals", f"""select transaction_id, count(*) filter (where amount < 50000) over b as n_below, coalesce(round(sum(amount) filter (where amount < 50000) over b, 2), 0) as sum_below,
  (count(*) filter (where amount < 50000) over b >= 3 and coalesce(sum(amount) filter (where amount < 50000) over b, 0) >= 75000)::int as rule_matched from transactions
  window b as (partition by account_id order by timestamp range between interval {BURST_HOURS} hours preceding and current row)""", "t")
def structuring_totals(spark, d):
    """The burst rule over whole windows: no limit on the rows it looks back to."""
    rows = B.burst_totals(txns(spark, d), BURST_S)
    return rows.select("transaction_id", "n_below", r("sum_below", 2), F.col("matched").cast("int").alias("rule_matched"))
