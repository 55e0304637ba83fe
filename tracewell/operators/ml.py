"""Scaling, splits, resampling, fitted detectors and attributions."""

from __future__ import annotations

import json
from itertools import combinations_with_replacement

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell import constants as C
from tracewell.functions import columns as X
from tracewell.functions.text import top_abs
from tracewell.operators import shapley
from tracewell.operators.history import order_of
from tracewell.operators.neighbours import nearest
from tracewell.operators.ordering import null_safe_join, positions
from tracewell.session import checkpointed, fresh_dir


# ---- scaling and splits

def scale(df: DataFrame, cols: list[str], kind: str = "standard", by: list[str] | None = None,
          fit: DataFrame | None = None, suffix: str = "_scaled") -> DataFrame:
    """Scaled copies of columns; statistics come from ``fit`` (training rows) when given.

    ``standard`` uses the population deviation, a constant column is only centred. ``minmax`` maps to 0..1.
    """
    source = df if fit is None else fit
    lo = {c: F.avg(c) if kind == "standard" else F.min(c) for c in cols}
    hi = {c: F.stddev_pop(c) if kind == "standard" else F.max(c) - F.min(c) for c in cols}
    parts = [e for c in cols for e in (lo[c].alias(f"_a_{c}"), hi[c].alias(f"_b_{c}"))]
    if by:
        joined = null_safe_join(df, source.groupBy(*by).agg(*parts), by, "left")
        get = lambda n: F.col(n)
    else:
        joined = df.withColumn("_st", source.agg(*parts).select(F.struct("*")).scalar())
        get = lambda n: F.col(f"_st.{n}")
    wide = joined.withColumns({
        f"{c}{suffix}": (F.col(c) - get(f"_a_{c}")) / F.when(get(f"_b_{c}") > 0, get(f"_b_{c}")).otherwise(1.0) for c in cols})
    return wide.select(*df.columns, *[f"{c}{suffix}" for c in cols])


def time_split(df: DataFrame, frac: float = 0.8, by: list[str] | None = None, val_frac: float | None = None) -> DataFrame:
    """Chronological split: the first share is ``train`` (its last part ``val`` if asked), the rest ``test``."""
    by = by or []
    placed = positions(df, by, order_of(df), "_at")
    # Counted on the placed rows, which are stored when they are many: ``df`` would be worked out again for its number of rows.
    sizes = placed.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    rows = null_safe_join(placed, sizes, by) if by else placed.withColumn("_n", sizes.select("_n").scalar())
    cut = F.floor(F.lit(frac) * F.col("_n"))
    name = F.when(F.col("_at") > cut, "test")
    if val_frac is not None:
        name = name.when(F.col("_at") > F.floor(F.lit(val_frac) * cut), "val")
    return rows.withColumn("split", name.otherwise("train")).drop("_at", "_n")


def account_split(df: DataFrame, label: str, key: str = "account_id", shares: tuple[float, float] = (0.70, 0.15), seed: int = 42) -> DataFrame:
    """Accounts with and without positives are each shuffled by hash and cut 70/15/15; rows follow their account."""
    accounts = df.groupBy(key).agg(F.max(label).alias("_stratum"))
    hashed = accounts.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key))))
    placed = positions(hashed, ["_stratum"], ["_h", key], "_at")
    sizes = accounts.groupBy("_stratum").agg(F.count(F.lit(1)).alias("_n"))
    placed = null_safe_join(placed, sizes, ["_stratum"])
    tr, va = F.floor(F.lit(shares[0]) * F.col("_n")), F.floor(F.lit(shares[1]) * F.col("_n"))
    split = F.when(F.col("_at") <= tr, "train").when(F.col("_at") <= tr + va, "val").otherwise("test")
    return df.join(placed.select(key, split.alias("split")), key)


# ---- resampling

def normal_hash(*keys: Column | str) -> Column:
    """Standard normal number fixed by its keys."""
    u, v = X.hashed_unit(F.lit("u"), *keys), X.hashed_unit(F.lit("v"), *keys)
    return F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(2.0 * np.pi) * v)


def _copies(rows: DataFrame, by: list[str], order: list[str], needed: Column) -> DataFrame:
    """Repeats rows so that each group gains exactly ``needed`` rows, spread evenly over its rows."""
    placed = positions(rows, by, order, "_i")
    base = F.floor(needed / F.col("_pos")).cast("int")
    extra = F.when(F.col("_i") <= needed % F.col("_pos"), 1).otherwise(0)
    times = F.greatest(F.lit(0), base + extra)
    return placed.where(times > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), times))).drop("_i")


def oversample(df: DataFrame, label: str, ratio: float = 5.0) -> DataFrame:
    """Repeats positives until there are ``ratio`` negatives per positive; ``copy`` is 0 on original rows."""
    counts = df.agg(F.struct(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")).alias("c"))
    pos = df.where(F.col(label) == 1).withColumn("_c", counts.scalar())
    pos = pos.withColumn("_pos", F.col("_c.pos")).withColumn(
        "_need", F.greatest(F.lit(0), F.floor(F.col("_c.neg") / F.lit(ratio)) - F.col("_c.pos")))
    more = _copies(pos, [], order_of(df), F.col("_need"))
    return df.withColumn("copy", F.lit(0)).unionByName(more.select(*df.columns, "copy"))


def jitter(access: DataFrame, n: int = 3, label: str = "is_suspicious", seed: int = 42) -> DataFrame:
    """Adds n noisy copies of suspicious rows: records N(0, 2) and at least 1, time N(0, 5 minutes)."""
    keys = [F.lit(seed), F.col("event_id"), F.col("copy")]
    rows = access.where(F.col(label) == 1).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(n))))
    records = F.greatest(F.lit(1.0), F.col("records_accessed") + 2.0 * normal_hash(F.lit("records"), *keys)).cast("int")
    shift = (5.0 * 60e6 * normal_hash(F.lit("time"), *keys)).cast("long")
    moved = rows.withColumns({"records_accessed": records,
                              "timestamp": F.timestamp_micros(F.unix_micros("timestamp") + shift)})
    return access.withColumn("copy", F.lit(0)).unionByName(moved.select(*access.columns, "copy"))


def smote(df: DataFrame, cols: list[str], label: str, by: str, unique: str = "event_id", k: int = 5, share: float = 0.10, seed: int = 42) -> DataFrame:
    """Synthetic positives per group between a positive and one of its k nearest, up to ``share`` of the negatives.

    Groups with fewer than two positives get none.
    """
    counts = df.groupBy(by).agg(F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) == 0).alias("_neg"))
    need = F.greatest(F.floor(F.lit(share) * F.col("_neg")), F.col("_pos")) - F.col("_pos")
    pos = null_safe_join(df.where(F.col(label) == 1), counts, [by]).where(F.col("_pos") >= 2).withColumn("_need", need)
    partners = nearest(pos, cols, by, unique, k).groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "ox"))).alias("near"))
    seeds = _copies(pos, [by], [unique], F.col("_need")).join(partners, F.col(unique) == F.col("id"))
    key = [F.lit(seed), F.col(unique), F.col("copy")]
    pick = F.floor(X.hashed_unit(F.lit("partner"), *key) * F.size("near")).cast("int") + 1
    u = X.hashed_unit(F.lit("step"), *key)
    other = F.element_at("near", pick)["ox"]
    new = [(F.col(c) + u * (F.element_at(other, i + 1) - F.col(c))).alias(c) for i, c in enumerate(cols)]
    return seeds.select(by, F.col(unique).alias("seed_id"), "copy", *new, F.lit(1).alias(label))


# ---- role baselines

def fit_role_baseline(normal: DataFrame, cols: list[str] = C.ROLE_FEATURES, k: int = 4, by: str = "role") -> DataFrame:
    """Per role: feature ranges, means and the k leading directions of the scaled features.

    All moments of all roles come from one aggregation; only a small matrix per role reaches the driver.
    """
    scaled = scale(normal, cols, "minmax", by=[by])
    x = [f"{c}_scaled" for c in cols]
    ranges = [e for c in cols for e in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))]
    pairs = list(combinations_with_replacement(range(len(cols)), 2))
    moments = scaled.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *ranges, *[F.avg(v).alias(f"m_{i}") for i, v in enumerate(x)],
                                     *[F.avg(F.col(x[i]) * F.col(x[j])).alias(f"p_{i}_{j}") for i, j in pairs])
    rows = []
    for r in moments.collect():
        mean = np.array([r[f"m_{i}"] for i in range(len(cols))])
        cov = np.zeros((len(cols), len(cols)))
        for i, j in pairs:
            cov[i, j] = cov[j, i] = r[f"p_{i}_{j}"] - mean[i] * mean[j]
        vecs = np.linalg.eigh(cov)[1][:, ::-1][:, :k]
        rows.append((r[by], [float(r[f"lo_{c}"]) for c in cols], [float(r[f"hi_{c}"]) for c in cols],
                     mean.tolist(), [v.tolist() for v in vecs.T]))
    return normal.sparkSession.createDataFrame(
        rows, f"{by} string, lo array<double>, hi array<double>, mean array<double>, axes array<array<double>>")


def role_errors(df: DataFrame, baseline: DataFrame, cols: list[str] = C.ROLE_FEATURES, by: str = "role") -> DataFrame:
    """Reconstruction error of each row from its role's directions, in total and per feature (``err_<feature>``)."""
    x = F.array(*[F.col(c).cast("double") for c in cols])
    # One baseline row per role.
    rows = df.join(F.broadcast(baseline), by, "left")
    z = F.zip_with(F.zip_with(x, F.col("lo"), lambda v, lo: v - lo), F.zip_with("hi", "lo", lambda h, lo: F.when(h > lo, h - lo).otherwise(1.0)), lambda v, w: v / w)
    rows = rows.withColumn("_c", F.zip_with(z, F.col("mean"), lambda v, m: v - m))
    proj = lambda axis: F.aggregate(F.zip_with(F.col("_c"), axis, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    rows = rows.withColumn("_w", F.transform("axes", proj))
    back = F.aggregate(F.arrays_zip("axes", "_w"), F.array_repeat(F.lit(0.0), len(cols)),
                       lambda s, e: F.zip_with(s, e["axes"], lambda a, b: a + b * e["_w"]))
    rows = rows.withColumn("_e", F.zip_with("_c", back, lambda a, b: (a - b) * (a - b)))
    total = F.aggregate("_e", F.lit(0.0), lambda s, v: s + v) / float(len(cols))
    out = rows.withColumn("fitted_error", total).withColumns({f"err_{c}": F.element_at("_e", i + 1) for i, c in enumerate(cols)})
    return out.drop("_c", "_w", "_e", "lo", "hi", "mean", "axes")


# ---- classifiers

def class_weight(df: DataFrame, label: str) -> DataFrame:
    """Positives weigh negatives / positives, so both classes count the same."""
    ratio = df.agg(F.count_if(F.col(label) == 0) / F.greatest(F.lit(1), F.count_if(F.col(label) == 1)))
    return df.withColumn("weight", F.when(F.col(label) == 1, ratio.scalar()).otherwise(1.0))


def fit_sequence(df: DataFrame, sequence: str = "sequence", label: str = "label", max_iter: int = 30, reg: float = 1e-3) -> PipelineModel:
    """Weighted logistic model on flattened sequences."""
    train = class_weight(flat_sequence(df, sequence).withColumn("label", F.col(label).cast("double")), "label")
    stages = [StandardScaler(inputCol="raw", outputCol="features", withMean=True),
              LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", maxIter=max_iter, regParam=reg)]
    return Pipeline(stages=stages).fit(train.select("raw", "label", "weight"))


def flat_sequence(df: DataFrame, sequence: str = "sequence") -> DataFrame:
    return df.withColumn("raw", array_to_vector(F.flatten(sequence)))


def fit_profile(df: DataFrame, cols: list[str] = C.PROFILE_FEATURES, label: str = "isfraud", validation: str | None = None,
                trees: int = 200, depth: int = 8, step: float = 0.1, seed: int = 42) -> PipelineModel:
    """Boosted trees with class weights; with a boolean ``validation`` column training stops once the error on it no longer falls."""
    train = class_weight(df.withColumn("label", F.col(label).cast("double")), "label").na.drop(subset=cols)
    gbt = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=step,
                        subsamplingRate=0.85, featureSubsetStrategy="0.85", seed=seed)
    if validation:
        gbt = gbt.setValidationIndicatorCol(validation)
    keep = [*cols, "label", "weight", *([validation] if validation else [])]
    return Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep"), gbt]).fit(train.select(*keep))


def probability(model: PipelineModel, df: DataFrame, name: str) -> DataFrame:
    """Positive-class probability; model columns other than it are dropped."""
    out = model.transform(df).withColumn(name, vector_to_array("probability")[1])
    return out.drop("rawPrediction", "probability", "prediction", "features", "raw")


def importances(model: PipelineModel, cols: list[str], spark: SparkSession) -> DataFrame:
    values = model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame([(c, float(v)) for c, v in zip(cols, values)], "feature string, importance double").orderBy(F.desc("importance"), "feature")


# ---- attributions

def attribute_linear(df: DataFrame, cols: list[str], weights: list[float], means: list[float], k: int = 3) -> DataFrame:
    """Exact contributions w * (x - mean) of a linear score, with the k largest by magnitude."""
    parts = [F.lit(float(w)) * (F.col(c) - F.lit(float(m))) for c, w, m in zip(cols, weights, means)]
    return df.withColumns({f"attr_{c}": p for c, p in zip(cols, parts)}).withColumn("top_features", top_abs(cols, parts, k))


def attribute_trees(model: PipelineModel, df: DataFrame, cols: list[str] = C.PROFILE_FEATURES, k: int = 3, path: str | None = None) -> DataFrame:
    """Exact Shapley values of a tree-ensemble score, with the k largest by magnitude.

    ``attributions`` sums with ``base_value`` to the raw score. ``path``: where :func:`save_model` put the model; it is saved to
    the shared folder if not given, as the trees are read from its node table.
    """
    spark = df.sparkSession
    if path is None:
        path = fresh_dir(spark, "ensemble")
        save_model(model, path, {})
    out = shapley.attribute(df, shapley.saved_ensemble(spark, model, f"{path}/model"), cols)
    names = F.array(*[F.lit(c) for c in cols])
    entries = F.transform("attributions", lambda v, i: F.struct((-F.abs(v)).alias("m"), i.alias("i"), v.alias("v")))
    top = F.transform(F.slice(F.array_sort(entries), 1, k), lambda e: F.struct(
        F.element_at(names, e["i"] + 1).alias("feature"), e["v"].alias("contribution")))
    return out.withColumn("top_features", top)


def mean_attribution(df: DataFrame, cols: list[str] = C.PROFILE_FEATURES) -> DataFrame:
    """Mean magnitude of every feature's contribution, largest first."""
    one = df.agg(*[F.avg(F.abs(F.element_at("attributions", i + 1))).alias(c) for i, c in enumerate(cols)])
    return one.unpivot([], cols, "feature", "mean_abs").orderBy(F.desc("mean_abs"), "feature")


# ---- persistence

def save_model(model: PipelineModel, path: str, settings: dict) -> None:
    """Fitted stages, and a JSON row with column order and thresholds beside them."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.active()
    spark.createDataFrame([(json.dumps(settings, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/settings")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    return PipelineModel.load(f"{path}/model"), json.loads(spark.read.text(f"{path}/settings").head()[0])
