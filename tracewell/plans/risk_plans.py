"""Alerts, case files, ensembles and counters over all detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell import constants as C
from tracewell.operators import detect as D
from tracewell.operators import dossier as O
from tracewell.operators import links as L
from tracewell.operators import risk as K
from tracewell.operators import roles as R
from tracewell.plans import graph_plans as GP
from tracewell.plans.graph_plans import TARGET
from tracewell.plans.history_plans import BURST_S, ROLE_ERROR, ROLE_LIMIT, RULE
from tracewell.plans.link_plans import ASOF, DRIVERS, FEATURES, PAIRS, SCORED
from tracewell.plans.registry import access, query, r, txns, us
from tracewell.session import checkpointed, fresh_dir
from tracewell.sources import writers

W = "partition by account_id order by timestamp, transaction_id"
LINKED = "(score > 0.5 or minutes <= 4)"
GAP2 = "cast(format('{:.2f}', minutes) as double)"
REASONS = f"""[case when days > 30 then 'is_dormant_account: {C.PROFILE_REASONS['is_dormant_account']}' end,
  case when ratio > 5 then 'amount_vs_historical_mean_ratio: {C.PROFILE_REASONS['amount_vs_historical_mean_ratio'].replace("'", "''")}' end,
  'balance_is_zero_after: {C.PROFILE_REASONS['balance_is_zero_after']}']"""
SIGNALS = f"""{PAIRS}, {FEATURES}, {SCORED}, {RULE}, {GP.EDGES}, {GP.DIGRAPH}, {GP.CYCLES}, {GP.RINGS},
  before as (select * from (select *, row_number() over (partition by transaction_id order by access_ts, access_id) as k from scored where access_ts <= txn_ts) where k = 1),
  after as (select * from (select *, row_number() over (partition by access_id order by txn_ts, transaction_id) as k from scored where txn_ts < access_ts) where k = 1),
  past as (select transaction_id, coalesce((epoch_us(timestamp) - epoch_us(lag(timestamp) over w)) / 1e6 / 86400, 999) as days, amount / (coalesce(avg(amount) over p, 0) + 1) as ratio
    from transactions window w as ({W}), p as ({W} rows between unbounded preceding and 1 preceding)),
  first_ring as (select * from (select account_id, closed_at, ring_score, cycle_path, round(q, 2) as quantum, row_number() over (partition by account_id order by closed_at, n, cycle_path) as k
    from rings, unnest(path) as u(account_id)) where k = 1),
  roles as (select *, {ROLE_ERROR} as err, round({ROLE_LIMIT}, 5) as lim, {ROLE_ERROR} > {ROLE_LIMIT} as odd from access_events),
  signals as (
    select 'transaction' as source, t.transaction_id as source_id, t.account_id, t.timestamp, t.is_fraud, round(b.score, 4) as link_score, cast(format('{{:.2f}}', b.minutes) as double) as link_gap,
      (b.score > 0.5 or b.minutes <= 4) as link_on, b.drivers, case when g.closed_at <= t.timestamp then g.ring_score end as ring_score,
      g.cycle_path, g.quantum, case when p.days > 30 and p.ratio > 10 then 0.85::double else 0.15::double end as profile_score, (p.days > 30 and p.ratio > 10) as profile_on, {REASONS} as reasons,
      case when x.matched then 0.9::double else 0.1::double end as burst_score, x.matched as burst_on, x.aggregate_amount, null::double as role_score, false as role_on, null::varchar[] as role_lines
    from transactions t left join (select *, {DRIVERS} as drivers from before) b using (transaction_id) left join first_ring g on g.account_id = t.account_id join past p using (transaction_id) join rule x using (transaction_id)
    union all select 'access', a.event_id::varchar, a.account_id, case when f.access_id is null then a.timestamp else f.txn_ts end, f.is_fraud, round(f.score, 4), cast(format('{{:.2f}}', f.minutes) as double),
      (f.score > 0.5 or f.minutes <= 4), f.drivers, null, null, null, null, false, null, null, false, null, least(1, a.err / greatest(0.01, a.lim))::double, a.odd,
      ['action_type_rarity (val: ' || case when a.action_type = 'override' then '0.8' else '0.1' end || ', error: 0.000)', 'same_branch_access (val: 1.0, error: 0.000)', 'access_frequency_today (val: 3.0, error: 0.000)']
    from roles a left join (select *, {DRIVERS} as drivers from after) f on f.access_id = a.event_id where a.odd or f.access_id is not null)"""
_WEIGHTED = [("link_score", 0.35), ("ring_score", 0.25), ("profile_score", 0.20), ("burst_score", 0.15), ("role_score", 0.05)]
_TOP = " + ".join(f"coalesce({c} * {w}::double, 0::double)" for c, w in _WEIGHTED)
_BOTTOM = " + ".join(f"case when {c} is not null then {w}::double else 0::double end" for c, w in _WEIGHTED)
_FIRED = [("link_score is not null and (link_on or link_gap <= 4)", "temporal_link"), ("ring_score is not null", "circular_transfer"), ("profile_on", "xgboost_profile"),
          ("burst_on", "lstm_structuring"), ("role_on", "role_autoencoder")]
_KEYS = ", ".join(f"case when {cond} then '{key}' end" for cond, key in _FIRED)
_LABELS = ", ".join(f"case when {cond} then '{C.MODULE_LABELS[key]}' end" for cond, key in _FIRED)
ALERTS = f"""{SIGNALS},
  scored_rows as (select *, (0::double + {_TOP}) / (0::double + {_BOTTOM}) as raw, list_filter([{_KEYS}], lambda x: x is not null) as keys, list_filter([{_LABELS}], lambda x: x is not null) as modules from signals),
  levelled as (select *, case when raw >= 0.7 or (list_contains(keys, 'temporal_link') and raw >= 0.5) or coalesce(is_fraud, 0) = 1 then 'CRITICAL' when raw >= 0.5 then 'HIGH' when raw >= 0.35 then 'MEDIUM' else 'LOW' end as severity,
    case when list_contains(keys, 'temporal_link') then 'temporal_link' when list_contains(keys, 'circular_transfer') then 'circular_transfer' when list_contains(keys, 'lstm_structuring') then 'structuring'
      when list_contains(keys, 'xgboost_profile') then 'profile_mismatch' else 'role_anomaly' end as incident_key,
    list_concat(list_concat(list_concat(list_concat(
      case when list_contains(keys, 'temporal_link') then list_concat(['Funds transferred within ' || format('{{:.1f}}', link_gap) || ' minutes of internal employee lookup (4-min window trigger).'], drivers) else [] end,
      case when ring_score is not null then ['Closed fund cycle detected: ' || cycle_path || ' with combined quantum of INR ' || format('{{:,.2f}}', quantum) || '.'] else [] end),
      case when profile_on then list_filter(reasons, lambda x: x is not null) else [] end),
      case when burst_on then ['Sub-threshold structuring burst detected: aggregate INR ' || format('{{:,.2f}}', aggregate_amount) || ' split below INR 50,000 CTR limit.'] else [] end),
      case when role_on then list_transform(role_lines, lambda x: 'Privilege baseline deviation: ' || x) else [] end) as lines
    from scored_rows where raw >= 0.45 or len(keys) > 0 or coalesce(is_fraud, 0) = 1),
  alerts as (select *, 'ALT_' || upper(substr(md5(source || '|' || source_id || '|' || array_to_string(keys, '+')), 1, 16)) as alert_id, cast(format('{{:.1f}}', raw * 100) as double) as score,
    severity || ' Anomaly: ' || case when len(modules) > 0 then array_to_string(list_slice(modules, 1, 2), ' + ') else 'Behavioral Outlier' end as title,
    case when len(lines) > 0 then array_to_string(list_slice(lines, 1, 3), ' | ') else 'Multi-module anomaly threshold exceeded.' end as summary from levelled)"""


def signals(spark, d):
    a, t = access(spark, d), txns(spark, d)
    return D.all_signals(a, t, D.find_rings(a, t), burst_window_s=BURST_S)


_STORED: dict[tuple[str, str], str] = {}


def alerts(spark, d):
    """The alert table. Its numbers (each event beside its partner, with its ring) are worked out and stored once for a session and
    table folder; a query writes the texts of the columns it reads."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _STORED:
        folder = fresh_dir(spark, "alerts")
        a, t = access(spark, d), txns(spark, d)
        D.matched_payments(a, t, D.find_rings(a, t), burst_window_s=BURST_S).write.parquet(f"{folder}/payments")
        D.matched_accesses(a, t).write.parquet(f"{folder}/accesses")
        _STORED[key] = folder
    return D.alerts_of_matched(*[spark.read.parquet(f"{_STORED[key]}/{kind}") for kind in ("payments", "accesses")], burst_window_s=BURST_S)


@query("link_alerts", f"""select transaction_id, access_id, account_id, round(score, 4) as link_score, cast(format('{{:.1f}}', round(score, 4) * 0.35::double / 0.35::double * 100) as double) as composite_risk_score,
  case when round(score, 4) * 0.35::double / 0.35::double >= 0.5 or is_fraud = 1 then 'CRITICAL' when round(score, 4) * 0.35::double / 0.35::double >= 0.35 then 'MEDIUM' else 'LOW' end as severity,
  'Funds transferred within ' || format('{{:.1f}}', {GAP2}) || ' minutes of internal employee lookup (4-min window trigger).' as first_evidence from scored""", "at", f"{PAIRS}, {FEATURES}, {SCORED}")
def link_alerts(spark, d):
    pairs = L.score_pairs(L.temporal_link(access(spark, d), txns(spark, d)))
    rows = K.evidence(K.severity(K.emit(K.fired(K.composite(pairs)))))
    return rows.select("transaction_id", "access_id", "account_id", "link_score", "composite_risk_score", "severity", F.col("evidence_points")[0].alias("first_evidence"))


@query("composite_risk", f"select source, source_id, round((0::double + {_TOP}) / (0::double + {_BOTTOM}), 6) as raw_composite from signals", "at", SIGNALS)
def composite_risk(spark, d):
    rows = K.composite(signals(spark, d))
    return rows.select("source", "source_id", r("raw_composite", 6))


@query("alerts", "select alert_id, account_id, epoch_us(timestamp) as ts_us, score as composite_risk_score, severity, incident_key, title as alert_title, summary, array_to_string(modules, ' + ') as modules from alerts", "at", ALERTS)
def all_alerts(spark, d):
    return alerts(spark, d).select("alert_id", "account_id", us("timestamp", "ts_us"), "composite_risk_score", "severity", "incident_key", "alert_title", "summary",
                                   F.array_join("fired_modules", " + ").alias("modules"))


@query("severity_counts", "select severity, incident_key, count(*) as n_alerts from alerts group by all", "at", ALERTS)
def severity_counts(spark, d):
    return alerts(spark, d).groupBy("severity", "incident_key").agg(F.count(F.lit(1)).alias("n_alerts"))


@query("alerts_topk", """select alert_id, severity, score as composite_risk_score from alerts order by case severity when 'CRITICAL' then 0 when 'HIGH' then 1 when 'MEDIUM' then 2 else 3 end, score desc, alert_id limit 50""", "at", ALERTS)
def alerts_topk(spark, d):
    return K.alert_queue(alerts(spark, d)).select("alert_id", "severity", "composite_risk_score")


@query("alert_evidence", "select alert_id, (k - 1)::int as pos, lines[k] as line from alerts, unnest(range(1, least(6, len(lines)) + 1)) as u(k)", "at", ALERTS)
def alert_evidence(spark, d):
    return alerts(spark, d).select("alert_id", F.posexplode("evidence_points").alias("pos", "line"))


@query("alert_scores", "select alert_id, name as module, round(s, 3) as score from (select alert_id, unnest(['temporal_link', 'circular_transfer', 'xgboost_profile', 'lstm_structuring', 'role_autoencoder']) as name, "
       "unnest([link_score, ring_score, profile_score, burst_score, role_score]) as s from alerts) where s is not null", "at", ALERTS)
def alert_scores(spark, d):
    return alerts(spark, d).select("alert_id", F.explode("module_scores").alias("module", "score"))


@query("incident", "select a.alert_id, a.incident_key, i.v as incident_name from alerts a join (values " + ", ".join(f"('{row[0]}', '{row[1]}')" for row in C.INCIDENTS) + ") i(k, v) on i.k = a.incident_key", "at", ALERTS)
def incident(spark, d):
    return alerts(spark, d).select("alert_id", "incident_key", F.col("historical_incident_parallel.incident_name").alias("incident_name"))


@query("case_search", "select alert_id, severity from alerts where severity = 'CRITICAL' and lower(title) like '%ring%'", "at", ALERTS)
def case_search(spark, d):
    return writers.case_filter(alerts(spark, d), "CRITICAL", "RING").select("alert_id", "severity")


@query("case_export", "select alert_id, severity, account_id from alerts where severity = 'HIGH'", "at", ALERTS)
def case_export(spark, d):
    rows = writers.to_json_rows(writers.case_filter(alerts(spark, d), "high"))
    return rows.select(*[F.get_json_object("payload", f"$.{c}").alias(c) for c in ("alert_id", "severity", "account_id")])


@query("alert_lookup", f"select alert_id, account_id from alerts where alert_id = (select min(alert_id) from alerts where account_id = '{TARGET}')", "at", ALERTS)
def alert_lookup(spark, d):
    rows = alerts(spark, d)
    # The id to look up stands in a table: the first one of the account.
    wanted = rows.where(F.col("account_id") == TARGET).agg(F.min("alert_id")).scalar()
    return K.alert_by_id(rows, wanted).select("alert_id", "account_id")


_ALL_WEIGHTS = repr(sum(C.DOSSIER_WEIGHTS.values()))


@query("dossier_composite", f"""select transaction_id, cast(format('{{:.1f}}', raw * 100) as double) as dossier_score, case when raw >= 0.7 then 'CRITICAL' when raw >= 0.45 then 'HIGH' when raw >= 0.25 then 'MEDIUM' else 'LOW' end as dossier_severity,
  case when burst_on then 'structuring' when profile_on then 'profile_mismatch' else 'temporal_link' end as incident_key from (select source_id as transaction_id, burst_on, profile_on,
  (0::double + coalesce(link_score, 0) * 0.4::double + profile_score * 0.3::double + burst_score * 0.2::double + 0::double * 0.1::double) / cast('{_ALL_WEIGHTS}' as double) as raw from signals where source = 'transaction')""", "at", SIGNALS)
def dossier_composite(spark, d):
    rows = D.transaction_signals(access(spark, d), txns(spark, d), burst_window_s=BURST_S)
    return K.dossier_composite(rows).select("transaction_id", "dossier_score", "dossier_severity", "incident_key")


@query("joint_ensemble", f"""select transaction_id, access_id, round(e, 6) as ensemble_score, case when e > 0.75 then 'CRITICAL' when e > 0.5 then 'HIGH' when e > 0.25 then 'MEDIUM' else 'LOW' end as ensemble_severity, (e > 0.25)::int as predicted_fraud
  from (select transaction_id, access_id, 0.85::double * coalesce((score - min(score) over ()) / nullif(max(score) over () - min(score) over (), 0), 0)
    + 0.15::double * ((err - lo) / (hi - lo + 1e-9)) as e from (
    select f.transaction_id, f.access_id, round(f.score, 4) as score, o.err, min(o.err) over (partition by o.role) as lo, max(o.err) over (partition by o.role) as hi from scored f join (select *, {ROLE_ERROR} as err from access_events) o on o.event_id = f.access_id))""", "at",
       f"{ASOF}, pairs as (select *, null as counterparty_id, null as scenario from asof_pairs), {FEATURES}, {SCORED}")
def joint_ensemble(spark, d):
    links = L.link_score(L.link_features(L.asof_access(txns(spark, d), access(spark, d))))
    roles = R.role_score(access(spark, d)).select("account_id", "timestamp", "role_error")
    rows = K.joint_ensemble(L.join_scores(links, roles))
    return rows.select("transaction_id", "access_id", r("ensemble_score", 6), "ensemble_severity", "predicted_fraud")


@query("timeline", """select transaction_id, access_id, epoch_us(access_ts) as ts_us, 'Employee ' || employee_id || ' (' || role || ')' as actor, 'Accessed ' || account_id || ' (' || account_type || ') at branch ' || access_branch as action from pairs
  union all select transaction_id, access_id, epoch_us(txn_ts), 'Account ' || account_id, transaction_type || ' of INR ' || format('{:,.2f}', amount) || ' to ' || counterparty_id from pairs""", "at", PAIRS)
def timeline(spark, d):
    rows = O.timeline(L.temporal_link(access(spark, d), txns(spark, d))).select("transaction_id", "access_id", F.explode("timeline").alias("e"))
    return rows.select("transaction_id", "access_id", us(F.col("e.timestamp"), "ts_us"), "e.actor", "e.action")


@query("dossier", f"select alert_id, severity, score as composite_risk_score, 'Trigger Transaction on ' || account_id as event, epoch_us(timestamp) as ts_us from alerts where account_id = '{TARGET}'", "at", ALERTS)
def dossier(spark, d):
    case, _, _ = O.dossier(alerts(spark, d), GP.nodes(spark, d), GP.edges(spark, d), TARGET)
    return case.select("alert_id", "severity", "composite_risk_score", F.col("timeline")[0]["event"].alias("event"), us(F.col("timeline")[0]["timestamp"], "ts_us"))


@query("dossier_neighbourhood", f"""select 'alert' as part, alert_id as id, severity as detail from alerts where account_id = '{TARGET}'
  union all select 'node', id, node_type from nodes where id in (select id from ego)
  union all select 'edge', src || '->' || dst, cast(key as varchar) from edges where src in (select id from ego) and dst in (select id from ego)""", "at", f"{ALERTS}, {GP.NODES}, {GP.EGO}")
def dossier_neighbourhood(spark, d):
    """The whole case file: alerts, and the nodes and edges around the account."""
    case, near, between = O.dossier(alerts(spark, d), GP.nodes(spark, d), GP.edges(spark, d), TARGET)
    return (case.select(F.lit("alert").alias("part"), F.col("alert_id").alias("id"), F.col("severity").alias("detail"))
            .unionByName(near.select(F.lit("node").alias("part"), "id", F.col("node_type").alias("detail")))
            .unionByName(between.select(F.lit("edge").alias("part"), F.concat_ws("->", "src", "dst").alias("id"), F.col("key").cast("string").alias("detail"))))


@query("alert_neighbourhoods", """select alert_id, n_edges, n_neighbours from alerts left join (select account_id, count(*) as n_edges, count(distinct other) as n_neighbours from (
  select src as account_id, dst as other from edges union all select dst, src from edges) group by account_id) using (account_id)""", "at", ALERTS)
def alert_neighbourhoods(spark, d):
    return O.neighbourhood_sizes(alerts(spark, d), GP.edges(spark, d)).select("alert_id", "n_edges", "n_neighbours")


@query("telemetry", """select (select count(*) from access_events) as total_access_events, (select count(*) from transactions) as total_transactions, (select count(*) from alerts) as total_alerts,
  (select count(*) from pairs) as temporal_correlations_detected, (select count(*) from rings) as circular_rings_detected, (select count(*) filter (where burst_on) from signals) as structuring_bursts_detected,
  (select count(*) filter (where profile_on) from signals) as profile_anomalies_detected,
  (select count(*) from pairs) + (select count(*) from rings) + (select count(*) filter (where burst_on) from signals) as patterns_detected""", "at", ALERTS)
def telemetry(spark, d):
    a, t = access(spark, d), txns(spark, d)
    rings = D.find_rings(a, t)
    rows = checkpointed(D.all_signals(a, t, rings, burst_window_s=BURST_S))  # counted and turned into alerts
    return O.telemetry(a, t, L.count_pairs(a, t), rings, rows, K.build_alerts(rows, ["source", "source_id"]))


COHESIVE = GP.RINGS.replace("ring_sums as (", f"""vecs as (select 'ACC_' || lpad(vec_id::varchar, 5, '0') as id, embedding from embeddings),
  members as (select path, h, src, v.embedding as vec from hops left join vecs v on v.id = src),
  cohesion as (select a.path, avg(case when a.vec is null or b.vec is null then 0 else greatest(-1, least(1, {GP.COS.format(a='a.vec', b='b.vec')})) end) as c from members a join members b on a.path = b.path and a.h < b.h group by a.path),
  ring_sums as (""").replace("0.05 * n + 0)", "0.05 * n + 0.15 * greatest(0, c))").replace("from ring_sums)", "from ring_sums join cohesion using (path))")


@query("alerts_cohesive", "select alert_id, score as composite_risk_score, severity, round(ring_score, 3) as ring_score from alerts where ring_score is not null", "at", ALERTS.replace(GP.RINGS, COHESIVE))
def alerts_cohesive(spark, d):
    """Alerts whose rings are scored with the cohesion of their members' vectors."""
    a, t = access(spark, d), txns(spark, d)
    vecs = spark.read.parquet(f"{d}/embeddings.parquet").select(F.concat(F.lit("ACC_"), F.lpad(F.col("vec_id").cast("string"), 5, "0")).alias("id"), F.col("embedding").alias("vec"))
    rows = D.alerts(a, t, D.find_rings(a, t, vecs), burst_window_s=BURST_S)
    ring = F.col("module_scores")["circular_transfer"]
    return rows.where(ring.isNotNull()).select("alert_id", "composite_risk_score", "severity", ring.alias("ring_score"))
