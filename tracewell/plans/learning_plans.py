"""Splits, scaling, resampling, evaluation and fitted detectors.

Fitted plans read their features several times, so they are checkpointed once.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tracewell import constants as C
from tracewell.operators import evaluate as V
from tracewell.operators import links as L
from tracewell.operators import ml as M
from tracewell.operators import nets as N
from tracewell.operators import profile as P
from tracewell.operators import risk as K
from tracewell.operators import roles as R
from tracewell.operators import structuring as B
from tracewell.operators.forest import IsolationForest
from tracewell.operators.risk import top_scores
from tracewell.operators.stats import keep_active
from tracewell.plans.history_plans import BURST_S, LABEL, W
from tracewell.plans.link_plans import ASOF, PAIRS
from tracewell.plans.registry import access, ledger, query, r, txns, us
from tracewell.session import checkpointed, fresh_dir
from tracewell.sources.readers import scored_types

# A transparent score for evaluation queries: the amount's share of 500 000.
SCORE = "scored as (select *, amount / 500000 as score, is_fraud as y from transactions)"
RATIOS = """case when tp + fp > 0 then round(tp / (tp + fp), 6) else 0 end::double as precision, case when tp + fn > 0 then round(tp / (tp + fn), 6) else 0 end::double as recall,
  case when tp > 0 then round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) else 0 end::double as f1,
  case when fp + tn > 0 then round(fp / (fp + tn), 6) else 0 end::double as fpr, case when tp + fn > 0 then round(fn / (fn + tp), 6) else 0 end::double as fnr"""
COUNTS = "count(*) filter (where y = 1 and p = 1) as tp, count(*) filter (where y = 0 and p = 1) as fp, count(*) filter (where y = 1 and p = 0) as fn, count(*) filter (where y = 0 and p = 0) as tn"
_RATIO_COLS = ["precision", "recall", "f1", "fpr", "fnr"]


def _scored(spark, d):
    return txns(spark, d).withColumn("score", F.col("amount") / 500000).withColumn("y", F.col("is_fraud"))


def _flagged(spark, d):
    return _scored(spark, d).withColumn("p", (F.col("score") >= 0.2).cast("int"))


@query("confusion", f"select tp, fp, fn, tn, {RATIOS} from (select {COUNTS} from (select *, (score >= 0.2)::int as p from scored))", "t", SCORE)
def confusion(spark, d):
    return V.confusion(_flagged(spark, d), "y", "p").select("tp", "fp", "fn", "tn", *[r(c, 6) for c in _RATIO_COLS])


@query("confusion_by_scenario", f"select scenario, tp, fp, fn, tn, {RATIOS} from (select scenario, {COUNTS} from (select *, (score >= 0.2)::int as p from scored) group by scenario)", "t", SCORE)
def confusion_by_scenario(spark, d):
    return V.confusion(_flagged(spark, d), "y", "p", ["scenario"]).select("scenario", "tp", "fp", "fn", "tn", *[r(c, 6) for c in _RATIO_COLS])


@query("fpr_clean", "select fp, tn, round(fp / (fp + tn), 6) as fpr from (select count(*) filter (where score >= 0.2 and y = 0) as fp, count(*) filter (where score < 0.2 and y = 0) as tn from scored where scenario = 'clean_busy')", "t", SCORE)
def fpr_clean(spark, d):
    return V.clean_fpr(_flagged(spark, d), "y", "p").select("fp", "tn", r("fpr", 6))


@query("model_compare", f"select model, tp, fp, fn, tn, {RATIOS.split(', case when tp + fn > 0 then round(fn')[0]} from (select 'loose' as model, {COUNTS} from (select *, (score >= 0.1)::int as p from scored) "
       f"union all select 'strict', {COUNTS} from (select *, (score >= 0.2)::int as p from scored))", "t", SCORE)
def model_compare(spark, d):
    loose = _scored(spark, d).withColumn("p", (F.col("score") >= 0.1).cast("int"))
    table = V.compare({"loose": V.confusion(loose, "y", "p"), "strict": V.confusion(_flagged(spark, d), "y", "p")})
    return table.select("model", "tp", "fp", "fn", "tn", *[r(c, 6) for c in _RATIO_COLS[:4]])


CURVE = """per as (select score, count(*) filter (where y = 1) as pos, count(*) filter (where y = 0) as neg from scored group by score),
  curve as (select score as threshold, pos, neg, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over () as p, sum(neg) over () as n from per window w as (order by score desc))"""


@query("pr_curve", "select threshold, tp::bigint as tp, fp::bigint as fp, round(tp / (tp + fp), 6) as precision, round(tp / p, 6) as recall, round(fp / n, 6) as fpr from curve", "t", f"{SCORE}, {CURVE}")
def pr_curve(spark, d):
    return V.curves(_scored(spark, d), "y", "score").select("threshold", "tp", "fp", r("precision", 6), r("recall", 6), r("fpr", 6))


@query("curve_areas", "select round(sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)), 6) as roc_auc, round(sum(pos * (tp / (tp + fp))) / sum(pos), 6) as average_precision from curve", "t", f"{SCORE}, {CURVE}")
def curve_areas(spark, d):
    return V.curve_areas(V.curves(_scored(spark, d), "y", "score")).select(r("roc_auc", 6), r("average_precision", 6))


def _grid(name: str, grid: list[float]) -> str:
    values = ", ".join(f"({g!r}::double)" for g in grid)
    return f"""{name} as (select th, {COUNTS} from (select th, y, (score >= th)::int as p from scored, (values {values}) g(th)) group by th),
  {name}_rates as (select *, case when tp + fp > 0 then tp / (tp + fp) else 0 end as pr, case when tp + fn > 0 then tp / (tp + fn) else 0 end as re from {name}),
  {name}_scores as (select *, case when pr + re > 0 then 2 * pr * re / (pr + re) else 0 end as f from {name}_rates)"""


BURST_GRID, PROFILE_GRID = _grid("grid", V.BURST_SEARCH[0]), _grid("grid", V.PROFILE_SEARCH[0])


@query("threshold_table", "select round(th, 9) as threshold, tp, fp, fn, tn, round(pr, 6) as precision, round(re, 6) as recall, round(f, 6) as f1 from grid_scores", "t", f"{SCORE}, {PROFILE_GRID}")
def threshold_table(spark, d):
    table = V.threshold_table(_scored(spark, d), "y", "score", V.PROFILE_SEARCH[0])
    return table.select(r("threshold", 9), "tp", "fp", "fn", "tn", r("precision", 6), r("recall", 6), r("f1", 6))


_PICK = "select round(th, 9) as threshold, round(pr, 6) as precision, round(re, 6) as recall, round(f, 6) as f1 from grid_scores where {any} order by {first} desc, f desc, th limit 1"


@query("threshold_search", _PICK.format(any="pr >= 0.01", first="(pr >= 0.01 and re >= 0.8)::int"), "t", f"{SCORE}, {PROFILE_GRID}")
def threshold_search(spark, d):
    return V.search_threshold(_scored(spark, d), "y", "score", *V.PROFILE_SEARCH).select(r("threshold", 9), r("precision", 6), r("recall", 6), r("f1", 6))


@query("threshold_search_burst", _PICK.format(any="true", first="(pr >= 0.5 and re >= 0.7)::int"), "t", f"{SCORE}, {BURST_GRID}")
def threshold_search_burst(spark, d):
    return V.search_threshold(_scored(spark, d), "y", "score", *V.BURST_SEARCH).select(r("threshold", 9), r("precision", 6), r("recall", 6), r("f1", 6))


@query("deviation_search", f"""select role, round(k, 4) as multiplier, round(pr, 6) as precision, round(re, 6) as recall, round(f, 6) as f1 from (
  select *, row_number() over (partition by role order by (re >= 0.8)::int desc, case when re >= 0.8 then f else re end desc, case when re >= 0.8 then k else -k end) as n from (
  select *, case when pr + re > 0 then 2 * pr * re / (pr + re) else 0 end as f from (
  select role, k, case when tp + fp > 0 then tp / (tp + fp) else 0 end as pr, case when tp + fn > 0 then tp / (tp + fn) else 0 end as re from (
  select role, k, {COUNTS} from (select a.role, g.i * 0.1::double + 1 as k, is_suspicious as y, (records_accessed > mu + (1.0::double + 0.1::double * g.i) * sd)::int as p from access_events a join (
    select role, avg(records_accessed) filter (where is_suspicious = 0) as mu, stddev_pop(records_accessed) filter (where is_suspicious = 0) as sd from access_events group by role) b using (role), range(0, 41) g(i)) group by role, k)))) where n = 1""", "a")
def deviation_search(spark, d):
    rows = access(spark, d).withColumn("s", F.col("records_accessed").cast("double"))
    return V.search_deviation(rows, "is_suspicious", "s", "role").select("role", r("multiplier"), r("precision", 6), r("recall", 6), r("f1", 6))


@query("pair_labels", "select scenario, count(*) filter (where is_fraud = 1) as n_positive, count(*) as n_rows from transactions group by scenario", "t")
def pair_labels(spark, d):
    rows = txns(spark, d).withColumn("label", V.pair_label(F.lit(0), "is_fraud"))
    return rows.groupBy("scenario").agg(F.sum("label").alias("n_positive"), F.count(F.lit(1)).alias("n_rows"))


@query("link_pair_labels", """select is_suspicious, is_fraud, (coalesce(is_suspicious, 0) = 1 or coalesce(is_fraud, 0) = 1)::int as label, count(*) as n_pairs from pairs group by all""", "at", PAIRS)
def link_pair_labels(spark, d):
    """Either side of a pair makes it positive."""
    rows = L.temporal_link(access(spark, d), txns(spark, d)).withColumn("label", V.pair_label())
    return rows.groupBy("is_suspicious", "is_fraud", "label").agg(F.count(F.lit(1)).alias("n_pairs"))


@query("chrono_split", """select transaction_id, case when i > floor(0.8 * n) then 'test' when i > floor(0.8 * floor(0.8 * n)) then 'val' else 'train' end as split from (
  select transaction_id, row_number() over (order by timestamp, transaction_id) as i, count(*) over () as n from transactions)""", "t")
def chrono_split(spark, d):
    return M.time_split(txns(spark, d), val_frac=0.8).select("transaction_id", "split")


@query("chrono_split_by_role", """select event_id, case when i > floor(0.8 * n) then 'test' else 'train' end as split from (
  select event_id, row_number() over (partition by role order by timestamp, event_id) as i, count(*) over (partition by role) as n from access_events)""", "a")
def chrono_split_by_role(spark, d):
    return M.time_split(access(spark, d), by=["role"]).select("event_id", "split")


@query("stratified_split", """select account_id, case when i <= floor(0.7 * n) then 'train' when i <= floor(0.7 * n) + floor(0.15 * n) then 'val' else 'test' end as split from (
  select account_id, row_number() over (partition by s order by md5('42:' || account_id), account_id) as i, count(*) over (partition by s) as n from (select account_id, max(isfraud) as s from ledger group by account_id))""", "l")
def stratified_split(spark, d):
    return M.account_split(ledger(spark, d), "isfraud").select("account_id", "split").distinct()


@query("standard_scale", """select transaction_id, round((amount - (select avg(amount) from transactions where is_fraud = 0)) / (select stddev_pop(amount) from transactions where is_fraud = 0), 6) + 0.0 as amount_scaled from transactions""", "t")
def standard_scale(spark, d):
    rows = txns(spark, d)
    return M.scale(rows, ["amount"], fit=rows.where(F.col("is_fraud") == 0)).select("transaction_id", r("amount_scaled", 6))


@query("scale_by_role", """select event_id, round((records_accessed - min(records_accessed) over w) / nullif(max(records_accessed) over w - min(records_accessed) over w, 0), 6) + 0.0 as records_accessed_scaled
  from access_events window w as (partition by role)""", "a")
def scale_by_role(spark, d):
    return M.scale(access(spark, d), ["records_accessed"], "minmax", by=["role"]).select("event_id", r("records_accessed_scaled", 6))


@query("oversample", """select transaction_id, 0 as copy from transactions union all select transaction_id, unnest(range(1, (need // pos + (i <= need % pos)::int)::int + 1))::int from (
  select transaction_id, row_number() over (order by timestamp, transaction_id) as i, pos, greatest(0, floor(neg / 5)::bigint - pos) as need from transactions,
  (select count(*) filter (where is_fraud = 1) as pos, count(*) filter (where is_fraud = 0) as neg from transactions) where is_fraud = 1)""", "t")
def oversample(spark, d):
    return M.oversample(txns(spark, d), "is_fraud").select("transaction_id", "copy")


@query("top_amounts", "select transaction_id, amount from transactions order by amount desc, transaction_id limit 10", "t")
def top_amounts(spark, d):
    return top_scores(txns(spark, d), "amount", 10, "transaction_id").select("transaction_id", "amount")


def _normal_sql(name: str) -> str:
    unit = lambda k: f"((('0x' || substr(md5('{k}|{name}|42|' || event_id || '|' || copy), 1, 15))::bigint)::double + 0.5) / 1152921504606846976.0::double"
    return f"sqrt(-2 * ln({unit('u')})) * cos(2 * pi() * {unit('v')})"


@query("jitter", f"""select event_id, 0 as copy, records_accessed::int as records_accessed, epoch_us(timestamp) as moved_us from access_events union all
  select event_id, copy::int, trunc(greatest(1, records_accessed + 2 * {_normal_sql('records')}))::int, epoch_us(timestamp) + trunc(3e8 * {_normal_sql('time')})::bigint
  from access_events, unnest(range(1, 4)) as c(copy) where is_suspicious = 1""", "a")
def jitter(spark, d):
    return M.jitter(access(spark, d)).select("event_id", "copy", "records_accessed", us("timestamp", "moved_us"))


@query("smote")
def smote(spark, d):
    rows = checkpointed(R.role_features(access(spark, d)))
    return M.smote(rows, C.ROLE_FEATURES, "is_suspicious", "role", share=0.25)


def _link_rows(spark, d):
    return L.link_features(L.asof_access(txns(spark, d), access(spark, d)), "account").na.fill(0.0, C.LINK_FEATURES)


@query("isolation_forest")
def isolation_forest(spark, d):
    """Fitted on the clean pairs of the first four fifths of the time; the rest is scored unseen."""
    rows = M.time_split(_link_rows(spark, d).withColumn("timestamp", F.col("txn_ts")))
    rows = checkpointed(rows)
    clean = (F.col("is_fraud_pair") == 0) & (F.col("split") == "train")
    scaled = checkpointed(M.scale(rows, C.LINK_FEATURES, fit=rows.where(clean)))
    cols = [f"{c}_scaled" for c in C.LINK_FEATURES]
    forest = IsolationForest(cols).fit(scaled.where(clean), ["transaction_id", "access_id"])
    scored = L.link_score(forest.score(scaled), "forest_score")
    return scored.select("transaction_id", "access_id", "split", "forest_score", "is_outlier", "link_score", "link_suspicious")


def _role_fit(spark, d):
    rows = checkpointed(M.time_split(R.role_features(access(spark, d)).na.fill(0.0)))
    baseline = M.fit_role_baseline(rows.where((F.col("is_suspicious") == 0) & (F.col("split") == "train")))
    return M.role_errors(rows, baseline)


@query("role_pca")
def role_pca(spark, d):
    rows = _role_fit(spark, d)
    limits = V.search_deviation(rows.where(F.col("split") == "train"), "is_suspicious", "fitted_error", "role").select("role", F.col("threshold").alias("role_threshold"))
    scored = R.unusual_features(R.role_score(rows, limits, "fitted_error"), [f"err_{c}" for c in C.ROLE_FEATURES])
    return scored.select("event_id", "role", "split", "role_error", "role_threshold", "role_anomalous", "role_drivers")


def _sequences(spark, d):
    rows = B.sequence_features(B.label_bursts(txns(spark, d), BURST_S))
    scaled = M.scale(rows, C.BURST_FEATURES)
    return B.sequence_tensor(B.emit_rows(scaled), [f"{c}_scaled" for c in C.BURST_FEATURES], 20).where("emitted")


@query("sequence_clf")
def sequence_clf(spark, d):
    rows = checkpointed(M.account_split(_sequences(spark, d), "is_structuring"))
    model = M.fit_sequence(rows.where(F.col("split") == "train"), label="is_structuring")
    scored = M.probability(model, M.flat_sequence(rows), "burst_probability")
    return scored.select("transaction_id", "split", "is_structuring", "burst_probability")


def _fitted_ensemble(spark, d):
    """Pairs with the isolation forest's link score and the role networks' error, both fitted on earlier time, joined and weighed."""
    rows = checkpointed(M.time_split(_link_rows(spark, d).withColumn("timestamp", F.col("txn_ts"))))
    clean = (F.col("is_fraud_pair") == 0) & (F.col("split") == "train")
    scaled = checkpointed(M.scale(rows, C.LINK_FEATURES, fit=rows.where(clean)))
    forest = IsolationForest([f"{c}_scaled" for c in C.LINK_FEATURES]).fit(scaled.where(clean), ["transaction_id", "access_id"])
    links = L.link_score(forest.score(scaled), "forest_score").select("transaction_id", "access_id", "role", "split", "is_fraud_pair", "link_score")
    roles = _role_net(spark, d).select(F.col("event_id").alias("access_id"), "role_error")
    return K.joint_ensemble(links.join(roles, "access_id"))


@query("fitted_ensemble", f"""select split, count(*) as n_pairs, sum(fraud)::bigint as n_positive, true as in_range from (
  select greatest(is_suspicious, is_fraud) as fraud, case when row_number() over (order by txn_ts, transaction_id) <= floor(0.8::double * count(*) over ()) then 'train' else 'test' end as split from asof_pairs) group by split""", "at", ASOF)
def fitted_ensemble(spark, d):
    """The ensemble over fitted scores, by split: every pair has a score in [0, 1], and the confusion adds up to the pairs."""
    rows = checkpointed(_fitted_ensemble(spark, d))
    table = V.confusion(rows, "is_fraud_pair", "predicted_fraud", ["split"])
    good = rows.groupBy("split").agg(F.bool_and(F.col("ensemble_score").between(0, 1)).alias("in_range"))
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return table.join(good, "split").select("split", n.alias("n_pairs"), (F.col("tp") + F.col("fn")).alias("n_positive"), "in_range")


SEQUENCE = 20
SPLIT_ROWS = f"""{LABEL}, emitted as (select * from (select *, row_number() over ({W}) - 1 as i, count(*) over (partition by account_id) as n from labelled) where is_structuring = 1 or i % 2 = 0 or i = n - 1),
strata as (select account_id, row_number() over (partition by s order by md5('42:' || account_id), account_id) as k, count(*) over (partition by s) as m from (select account_id, max(is_structuring) as s from emitted group by account_id)),
labelled_split as (select emitted.*, case when k <= floor(0.7 * m) then 'train' when k <= floor(0.7 * m) + floor(0.15 * m) then 'val' else 'test' end as split from emitted join strata using (account_id))"""


@query("sequence_net", """select split, count(*) as n_rows, sum(is_structuring)::bigint as n_positive, true as scored from labelled_split group by split""", "t", SPLIT_ROWS)
def sequence_net(spark, d):
    """Recurrent model with attention, fitted on the training accounts: what it scored, by split."""
    scored = _sequence_net(spark, d)
    good = F.col("burst_probability").between(0, 1) & (F.abs(F.aggregate("attention", F.lit(0.0), lambda a, v: a + v) - 1) < 1e-9)
    return scored.groupBy("split").agg(F.count("*").alias("n_rows"), F.sum("is_structuring").alias("n_positive"), F.bool_and(good).alias("scored"))


def _sequence_net(spark, d):
    rows = checkpointed(M.account_split(_sequences(spark, d), "is_structuring").select("transaction_id", "split", "is_structuring", "sequence"))
    weights, _ = N.fit_sequences(rows.where(F.col("split") == "train"), "sequence", "is_structuring", SEQUENCE, len(C.BURST_FEATURES), steps=30)
    return N.score_sequences(rows, weights, "sequence", SEQUENCE, "burst_probability")


@query("role_net", """select role, count(*) as n_rows, sum(is_suspicious)::bigint as n_positive, true as adds_up, true as has_errors
  from (select *, row_number() over (order by timestamp, event_id) as place, count(*) over () as n from access_events) where place > floor(0.8::double * n) group by role""", "a")
def role_net(spark, d):
    """Bottleneck networks of the roles, fitted on earlier normal rows, their thresholds too; the later rows' confusion by role."""
    rows = _role_net(spark, d)
    later = rows.where(F.col("split") == "test").withColumn("flagged", F.col("role_anomalous").cast("int"))
    table = V.confusion(later, "is_suspicious", "flagged", ["role"])
    errors = later.groupBy("role").agg(F.bool_and((F.col("fitted_error") >= 0) & (F.abs(F.col("fitted_error") - sum(F.col(f"err_{c}") for c in C.ROLE_FEATURES) / len(C.ROLE_FEATURES)) < 1e-9)).alias("has_errors"))
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return table.join(errors, "role").select("role", n.alias("n_rows"), (F.col("tp") + F.col("fn")).alias("n_positive"), (n > 0).alias("adds_up"), "has_errors")


def _role_net(spark, d):
    rows = checkpointed(M.time_split(R.role_features(access(spark, d)).na.fill(0.0)))
    early = rows.where(F.col("split") == "train")
    model = N.fit_groups(early.where(F.col("is_suspicious") == 0), C.ROLE_FEATURES, "role", steps=40)
    errors = checkpointed(N.group_errors(rows, model, "role"))
    limits = V.search_deviation(errors.where(F.col("split") == "train"), "is_suspicious", "fitted_error", "role").select("role", F.col("threshold").alias("role_threshold"))
    return R.role_score(errors, limits, "fitted_error")


def _profiles(spark, d):
    # Stored, as counts of heavy accounts, of heavy pairs and the windows all go over these rows.
    return P.profile_features(checkpointed(keep_active(scored_types(ledger(spark, d)), "account_id", 2)))


_FITTED: dict[tuple[str, str], str] = {}


def _profile_fit(spark, d):
    """(model, its rows, the folder of both): fitted and stored once for a session and table folder, then loaded."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _FITTED:
        folder = fresh_dir(spark, "profile-model")
        M.time_split(_profiles(spark, d), val_frac=0.8).write.parquet(f"{folder}/rows")
        rows = spark.read.parquet(f"{folder}/rows")
        train = rows.where(F.col("split") != "test").withColumn("held_out", F.col("split") == "val")
        M.save_model(M.fit_profile(train, validation="held_out"), folder, {"columns": C.PROFILE_FEATURES, "threshold": C.PROFILE_THRESHOLD})
        _FITTED[key] = folder
    folder = _FITTED[key]
    return M.load_model(spark, folder)[0], spark.read.parquet(f"{folder}/rows"), folder


@query("profile_gbt")
def profile_gbt(spark, d):
    model, rows, _ = _profile_fit(spark, d)
    scored = P.profile_score(M.probability(model, rows, "fraud_probability"), "fraud_probability")
    return scored.select("txn_key", "split", "isfraud", "fraud_probability", "profile_score", "profile_anomalous")


@query("feature_importances")
def feature_importances(spark, d):
    return M.importances(_profile_fit(spark, d)[0], C.PROFILE_FEATURES, spark)


@query("attribution")
def attribution(spark, d):
    model, rows, folder = _profile_fit(spark, d)
    found = M.attribute_trees(model, rows, path=folder)
    return found.select("txn_key", "base_value", F.explode("top_features").alias("x")).select("txn_key", "base_value", "x.feature", "x.contribution")


@query("mean_attribution")
def mean_attribution(spark, d):
    model, rows, folder = _profile_fit(spark, d)
    return M.mean_attribution(M.attribute_trees(model, rows, path=folder))


@query("shapley_additivity", f"""select txn_key, {len(C.PROFILE_FEATURES)}::bigint as n_values, true as adds_up, true as agrees_with_probability
  from (select *, count(*) over (partition by account_id) as n from ledger where type in ('TRANSFER', 'CASH_OUT')) where n >= 2""", "l")
def shapley_additivity(spark, d):
    """Every row's base value and Shapley values are the model's raw score, and so its probability."""
    model, rows, folder = _profile_fit(spark, d)
    scored = model.transform(M.attribute_trees(model, rows, path=folder))
    total = F.col("base_value") + F.aggregate("attributions", F.lit(0.0), lambda a, v: a + v)
    raw, odds = vector_to_array("rawPrediction")[1], vector_to_array("probability")[1]
    return scored.select("txn_key", F.size("attributions").cast("long").alias("n_values"), (F.abs(total - raw) < 1e-9 * (1 + F.abs(raw))).alias("adds_up"),
                         (F.abs(1 / (1 + F.exp(-2 * total)) - odds) < 1e-9).alias("agrees_with_probability"))


@query("linear_attribution", """select txn_key, round(0.002 * (amount - 1000), 6) + 0.0 as amount_part, round(-0.001 * (balance - 5000), 6) + 0.0 as balance_part,
  case when abs(0.002 * (amount - 1000)) >= abs(-0.001 * (balance - 5000)) then 'amount' else 'oldbalanceorg' end as top_feature from (select txn_key, amount, oldbalanceorg as balance from ledger)""", "l")
def linear_attribution(spark, d):
    rows = M.attribute_linear(ledger(spark, d), ["amount", "oldbalanceorg"], [0.002, -0.001], [1000.0, 5000.0], k=1)
    return rows.select("txn_key", r("attr_amount", 6, "amount_part"), r("attr_oldbalanceorg", 6, "balance_part"), F.col("top_features")[0]["feature"].alias("top_feature"))
