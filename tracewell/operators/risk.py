"""Combining detector results into ranked alerts with evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell import constants as C
from tracewell.functions import text
from tracewell.functions.columns import clip
from tracewell.operators.stats import minmax

# Detector columns and their types; a detector that did not run has NULLs.
SIGNALS = {
    "link_score": "double", "link_gap": "double", "link_suspicious": "boolean", "link_drivers": "array<string>",
    "ring_score": "double", "ring_path": "string", "ring_quantum": "double",
    "profile_score": "double", "profile_anomalous": "boolean",
    "profile_reasons": "array<struct<feature:string,value:double,shap_contribution:double,explanation:string>>",
    "burst_score": "double", "burst_detected": "boolean", "aggregate_amount": "double",
    "role_component": "double", "role_anomalous": "boolean", "role_drivers": "array<string>",
    "is_fraud": "int",
}


def with_signals(df: DataFrame) -> DataFrame:
    """Adds the columns of detectors that are not there, as NULL."""
    return df.withColumns({n: F.lit(None).cast(t) for n, t in SIGNALS.items() if n not in df.columns})


def _scores() -> dict[str, Column]:
    """Detector scores in weighting order."""
    return {
        "temporal_link": F.col("link_score"), "circular_transfer": F.col("ring_score"),
        "xgboost_profile": F.col("profile_score"), "lstm_structuring": F.col("burst_score"),
        "role_autoencoder": F.col("role_component"),
    }


def composite(df: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted mean over the detectors that are present; NULL when none is."""
    weights = weights or C.RISK_WEIGHTS
    df = with_signals(df)
    top, bottom = F.lit(0.0), F.lit(0.0)
    for name, score in _scores().items():
        top = top + F.coalesce(score * F.lit(weights[name]), F.lit(0.0))
        bottom = bottom + F.when(score.isNotNull(), F.lit(weights[name])).otherwise(0.0)
    raw = F.when(bottom > 0, top / bottom)
    return df.withColumn("raw_composite", raw).withColumn(
        "composite_risk_score", text.round_even(F.col("raw_composite") * 100.0, 1))


def _fires() -> dict[str, Column]:
    yes = lambda c: F.coalesce(c, F.lit(False))
    return {
        "temporal_link": yes(F.col("link_score").isNotNull() & (
            yes(F.col("link_suspicious")) | (F.coalesce("link_gap", F.lit(999.0)) <= 4.0))),
        "circular_transfer": F.col("ring_score").isNotNull(),
        "xgboost_profile": yes(F.col("profile_anomalous")),
        "lstm_structuring": yes(F.col("burst_detected")),
        "role_autoencoder": yes(F.col("role_anomalous")),
    }


def fired(df: DataFrame) -> DataFrame:
    """Labels of the detectors that fired, in fixed order, and the same as keys."""
    fires = _fires()
    return df.withColumn("fired_keys", text.text_list(*[F.when(c, n) for n, c in fires.items()])).withColumn(
        "fired_modules", text.text_list(*[F.when(c, C.MODULE_LABELS[n]) for n, c in fires.items()]))


def emit(df: DataFrame, threshold: float = C.ALERT_THRESHOLD, use_label_flag: bool = True) -> DataFrame:
    """Drops a row only when its score is low, no detector fired and (if used) its label is not fraud."""
    keep = (F.col("raw_composite") >= threshold) | (F.size("fired_keys") > 0)
    if use_label_flag:
        keep = keep | (F.coalesce("is_fraud", F.lit(0)) == 1)
    return df.where(F.col("raw_composite").isNotNull() & keep)


def severity(df: DataFrame, use_label_flag: bool = True) -> DataFrame:
    raw = F.col("raw_composite")
    urgent = (raw >= 0.70) | (F.array_contains("fired_keys", "temporal_link") & (raw >= 0.50))
    if use_label_flag:
        urgent = urgent | (F.coalesce("is_fraud", F.lit(0)) == 1)
    return df.withColumn("severity", F.when(urgent, "CRITICAL").when(raw >= 0.50, "HIGH")
                         .when(raw >= 0.35, "MEDIUM").otherwise("LOW"))


def action(level: Column, texts: dict[str, str] = C.ALERT_ACTIONS) -> Column:
    out = F.lit(texts["LOW"])
    for name in ("MEDIUM", "HIGH", "CRITICAL"):
        out = F.when(level == name, texts[name]).otherwise(out)
    return out


def incident_catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(C.INCIDENTS, "incident_key string, incident_name string, quantum string, "
                                              "description string, pmla_sections string, regulatory_trigger string")


def incident(df: DataFrame, catalogue: DataFrame | None = None) -> DataFrame:
    """Label by the first detector that fired in precedence order, with its catalogue entry as a struct."""
    has = lambda n: F.array_contains("fired_keys", n)
    key = (F.when(has("temporal_link"), "temporal_link").when(has("circular_transfer"), "circular_transfer")
           .when(has("lstm_structuring"), "structuring").when(has("xgboost_profile"), "profile_mismatch")
           .otherwise("role_anomaly"))
    return _with_incident(df.withColumn("incident_key", key), catalogue)


def _with_incident(df: DataFrame, catalogue: DataFrame | None) -> DataFrame:
    catalogue = catalogue if catalogue is not None else incident_catalogue(df.sparkSession)
    packed = catalogue.select("incident_key", F.struct(*[c for c in catalogue.columns if c != "incident_key"]).alias("historical_incident_parallel"))
    # The catalogue has one row per incident kind.
    return df.join(F.broadcast(packed), "incident_key", "left")


def evidence(df: DataFrame, limit: int = 6) -> DataFrame:
    """Evidence lines in detector order, the title and the summary."""
    fires = _fires()
    link = F.when(fires["temporal_link"], text.lists(
        F.array(F.concat(F.lit("Funds transferred within "), text.fmt_fixed(F.coalesce("link_gap", F.lit(0.0))),
                         F.lit(" minutes of internal employee lookup (4-min window trigger)."))), F.col("link_drivers")))
    ring = F.when(fires["circular_transfer"], F.array(F.concat(
        F.lit("Closed fund cycle detected: "), F.coalesce("ring_path", F.lit("")), F.lit(" with combined quantum of INR "),
        text.fmt_money(F.coalesce("ring_quantum", F.lit(0.0))), F.lit("."))))
    reasons = F.when(fires["xgboost_profile"], F.transform(
        "profile_reasons", lambda r: F.concat(r["feature"], F.lit(": "), r["explanation"])))
    burst = F.when(fires["lstm_structuring"], F.array(F.concat(
        F.lit("Sub-threshold structuring burst detected: aggregate INR "), text.fmt_money(F.coalesce("aggregate_amount", F.lit(0.0))),
        F.lit(" split below INR 50,000 CTR limit."))))
    role = F.when(fires["role_autoencoder"], F.transform(
        "role_drivers", lambda d: F.concat(F.lit("Privilege baseline deviation: "), d)))
    lines = df.withColumn("_lines", text.lists(link, ring, reasons, burst, role))
    return lines.withColumns({
        "evidence_points": F.slice("_lines", 1, limit),
        "summary": F.when(F.size("_lines") > 0, F.array_join(F.slice("_lines", 1, 3), " | "))
        .otherwise("Multi-module anomaly threshold exceeded."),
        "alert_title": F.concat(F.col("severity"), F.lit(" Anomaly: "), F.when(
            F.size("fired_modules") > 0, F.array_join(F.slice("fired_modules", 1, 2), " + ")).otherwise("Behavioral Outlier")),
        "top_shap_features": F.slice(F.when(fires["xgboost_profile"], F.transform("profile_reasons", lambda r: F.struct(
            r["feature"].alias("feature"), r["shap_contribution"].alias("importance"), r["explanation"].alias("reason")))), 1, 4),
    }).drop("_lines")


def alert_id(*keys: Column | str) -> Column:
    """Same keys, same id."""
    return F.concat(F.lit("ALT_"), F.upper(F.substring(F.md5(F.concat_ws("|", *keys)), 1, 16)))


def build_alerts(signals: DataFrame, keys: list[str], use_label_flag: bool = True,
                 threshold: float = C.ALERT_THRESHOLD) -> DataFrame:
    """From detector columns to alerts. ``keys`` make a row's id; ``raw_event`` is passed through if present."""
    rows = emit(fired(composite(signals)), threshold, use_label_flag)
    rows = evidence(incident(severity(rows, use_label_flag)))
    raw = [F.col("raw_event")] if "raw_event" in rows.columns else []
    return rows.select(
        alert_id(*keys, F.array_join("fired_keys", "+")).alias("alert_id"), "account_id", "timestamp", "composite_risk_score",
        "raw_composite", "severity", F.lit("ACTIVE").alias("status"), "alert_title", "summary", "fired_modules",
        text.score_map(_scores(), 3).alias("module_scores"), "top_shap_features", "evidence_points", "incident_key",
        "historical_incident_parallel", action(F.col("severity")).alias("recommended_action"), *raw)


def severity_rank(level: Column | str = "severity") -> Column:
    level = F.col(level) if isinstance(level, str) else level
    return (F.when(level == "CRITICAL", 0).when(level == "HIGH", 1).when(level == "MEDIUM", 2)
            .when(level == "LOW", 3).otherwise(4))


def alert_queue(alerts: DataFrame, level: str | None = None, limit: int = 50) -> DataFrame:
    """Most severe first, then highest score; the id breaks ties. ``limit`` must be in 1..200."""
    if not 1 <= limit <= 200:
        raise ValueError("limit must be between 1 and 200")
    rows = alerts.where(F.upper("severity") == level.upper()) if level else alerts
    return rows.orderBy(severity_rank(), F.desc("composite_risk_score"), "alert_id").limit(limit)


def alert_by_id(alerts: DataFrame, wanted: str | Column) -> DataFrame:
    return alerts.where(F.col("alert_id") == wanted)


def top_scores(df: DataFrame, score: str, k: int = 10, tie: str | None = None) -> DataFrame:
    return df.orderBy(F.desc(score), *([tie] if tie else [])).limit(k)


def dossier_composite(df: DataFrame, weights: dict[str, float] | None = None, role_limit: float = C.ROLE_THRESHOLD_DEFAULT) -> DataFrame:
    """Case-file score: detectors that are missing count 0 and all weights divide.

    The role score is error over ``role_limit``, since the case file does not carry the role's own threshold.
    """
    weights = weights or C.DOSSIER_WEIGHTS
    df = with_signals(df)
    role = clip(F.col("role_error") / F.lit(max(0.01, role_limit)), hi=1.0) if "role_error" in df.columns else F.lit(None).cast("double")
    scores = {"isolation_forest": F.col("link_score"), "xgboost": F.col("profile_score"), "lstm": F.col("burst_score"), "autoencoder": role}
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    fires = {"isolation_forest": yes("link_suspicious"), "autoencoder": yes("role_anomalous"),
             "lstm": yes("burst_detected"), "xgboost": yes("profile_anomalous")}
    top = F.lit(0.0)
    for name, w in weights.items():
        top = top + F.coalesce(scores[name], F.lit(0.0)) * F.lit(w)
    raw = top / F.lit(sum(weights.values()))
    level = F.when(raw >= 0.70, "CRITICAL").when(raw >= 0.45, "HIGH").when(raw >= 0.25, "MEDIUM").otherwise("LOW")
    key = (F.when(fires["lstm"], "structuring").when(fires["xgboost"], "profile_mismatch")
           .when(fires["autoencoder"], "role_anomaly").otherwise("temporal_link"))
    tag = lambda module, line: F.struct(F.lit(module).alias("module"), line.alias("evidence"))
    none = F.array().cast("array<struct<module:string,evidence:string>>")
    burst_line = F.coalesce(F.col("burst_evidence"), F.lit("Structuring detected")) if "burst_evidence" in df.columns else F.lit("Structuring detected")
    drivers = F.concat(
        F.coalesce(F.when(fires["isolation_forest"], F.transform("link_drivers", lambda d: tag("Temporal Link", d))), none),
        F.coalesce(F.when(fires["autoencoder"], F.transform(
            "role_drivers", lambda d: tag("Role Autoencoder", F.concat(F.lit("Unusual baseline: "), d)))), none),
        F.coalesce(F.when(fires["lstm"], F.array(tag("LSTM Structuring", burst_line))), none),
        F.coalesce(F.when(fires["xgboost"], F.transform("profile_reasons", lambda r: tag(
            "XGBoost SHAP", F.concat(r["feature"], F.lit(": "), r["explanation"])))), none))
    out = df.withColumns({
        "dossier_score": text.round_even(raw * 100.0, 1), "dossier_severity": level, "incident_key": key,
        "fired_modules": text.text_list(*[F.when(c, C.DOSSIER_LABELS[n]) for n, c in fires.items()]),
        "module_scores": text.score_map({n: scores[n] for n in ("isolation_forest", "autoencoder", "lstm", "xgboost")}, 4),
        "key_drivers": drivers, "recommended_action": action(level, C.DOSSIER_ACTIONS)})
    return _with_incident(out, None)


def joint_ensemble(joined: DataFrame, link: str = "link_score", role: str = "role_error",
                   weights: tuple[float, float] = C.JOINT_WEIGHTS) -> DataFrame:
    """Offline ensemble of min-max scaled link and role scores, the role score scaled per role."""
    scaled = minmax(minmax(joined, link, name="link_norm"), role, by=["role"], name="role_norm")
    score = F.lit(weights[0]) * F.coalesce("link_norm", F.lit(0.0)) + F.lit(weights[1]) * F.col("role_norm")
    return scaled.withColumn("ensemble_score", score).withColumns({
        "ensemble_severity": F.when(F.col("ensemble_score") > 0.75, "CRITICAL").when(F.col("ensemble_score") > 0.50, "HIGH")
        .when(F.col("ensemble_score") > 0.25, "MEDIUM").otherwise("LOW"),
        "predicted_fraud": (F.col("ensemble_score") > 0.25).cast("int")})
