"""Confusion counts, curves and threshold searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.ordering import running
from tracewell.operators.stats import quantiles


def pair_label(suspicious: Column | str = "is_suspicious", fraud: Column | str = "is_fraud") -> Column:
    one = lambda c: F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0)) == 1
    return (one(suspicious) | one(fraud)).cast("int")


def rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Ratios of confusion counts; an empty denominator gives 0."""
    part = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    precision, recall = part(tp, tp + fp), part(tp, tp + fn)
    return {"precision": precision, "recall": recall, "f1": part(2.0 * precision * recall, precision + recall),
            "fpr": part(fp, fp + tn), "fnr": part(fn, fn + tp)}


def confusion(df: DataFrame, label: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """Counts and ratios of 0/1 predictions."""
    y, p = F.col(label) == 1, F.col(pred) == 1
    counts = df.groupBy(*(by or [])).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
                                         F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    return counts.withColumns(rates(*[F.col(c) for c in ("tp", "fp", "fn", "tn")]))


def clean_fpr(df: DataFrame, label: str, pred: str, scenario: str = "clean_busy") -> DataFrame:
    """False-positive rate on the benign scenario."""
    return confusion(df.where(F.col("scenario") == scenario), label, pred).select("fp", "tn", "fpr")


def curves(df: DataFrame, label: str, score: str) -> DataFrame:
    """Every distinct threshold with its counts, precision, recall and false-positive rate.

    Rows are first counted per score; running totals over the ordered scores need no single task.
    """
    per = df.groupBy(F.col(score).alias("threshold")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    cum = running(per, [], [F.desc("threshold")], {"tp": ("sum", F.col("pos")), "fp": ("sum", F.col("neg"))})
    total = per.agg(F.struct(F.sum("pos").alias("p"), F.sum("neg").alias("n")).alias("t"))
    part = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return cum.withColumn("_t", total.scalar()).withColumns({
        "precision": part(F.col("tp"), F.col("tp") + F.col("fp")), "recall": part(F.col("tp"), F.col("_t.p")),
        "fpr": part(F.col("fp"), F.col("_t.n"))}).select("threshold", "pos", "neg", "tp", "fp", "precision", "recall", "fpr")


def curve_areas(curve: DataFrame) -> DataFrame:
    """Area under ROC (trapezoids) and average precision (steps) of a curve."""
    p, n = F.sum("pos"), F.sum("neg")
    strip = F.col("neg") * (F.col("tp") - F.col("pos") / 2.0)
    return curve.agg(F.coalesce(F.try_divide(F.sum(strip), p * n), F.lit(0.0)).alias("roc_auc"),
                     F.coalesce(F.try_divide(F.sum(F.col("pos") * F.col("precision")), p), F.lit(0.0)).alias("average_precision"))


def threshold_table(df: DataFrame, label: str, score: str, grid: list[float], strict: bool = False) -> DataFrame:
    """Counts and ratios at each threshold of an ascending, evenly spaced grid.

    Each row falls into one grid interval, intervals are counted, and counts are summed from the top: one
    aggregation whatever the grid size. ``strict`` predicts score > threshold instead of >=.
    """
    n, lo = len(grid), grid[0]
    width = (grid[-1] - lo) / (n - 1)
    steps = F.array(*[F.lit(g) for g in grid])
    s = F.col(score)
    passes = (lambda g: s > g) if strict else (lambda g: s >= g)
    guess = F.greatest(F.lit(0), F.least(F.lit(n), F.floor((s - lo) / width).cast("int") + 1))
    # The guess can be one off at a grid point; comparing with the neighbouring thresholds settles it.
    at = lambda i: F.try_element_at(steps, i)
    slot = (F.when((guess < n) & passes(at(guess + 1)), guess + 1)
            .when((guess > 0) & ~passes(at(F.greatest(guess, F.lit(1)))), guess - 1).otherwise(guess))
    counts = df.where(s.isNotNull()).groupBy(slot.alias("slot")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    table = df.sparkSession.createDataFrame([(0, None), *[(i + 1, float(g)) for i, g in enumerate(grid)]], "slot int, threshold double")
    down = Window.partitionBy(F.lit(0)).orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(F.lit(0))
    filled = table.join(counts, "slot", "left").fillna(0, ["pos", "neg"])
    summed = filled.select("threshold", F.sum("pos").over(down).alias("tp"), F.sum("neg").over(down).alias("fp"),
                           F.sum("pos").over(whole).alias("_p"), F.sum("neg").over(whole).alias("_n"))
    out = summed.withColumn("fn", F.col("_p") - F.col("tp")).withColumn("tn", F.col("_n") - F.col("fp")).drop("_p", "_n")
    return out.where(F.col("threshold").isNotNull()).withColumns(rates(*[F.col(c) for c in ("tp", "fp", "fn", "tn")]))


def linspace(lo: float, hi: float, n: int) -> list[float]:
    step = (hi - lo) / (n - 1)
    return [hi if i == n - 1 else lo + step * i for i in range(n)]


# Grid and tries of the two score searches: (least precision, least recall), in order.
BURST_SEARCH = (linspace(0.10, 0.90, 81), [(0.50, 0.70), (0.0, 0.0)])
PROFILE_SEARCH = (linspace(0.01, 0.99, 200), [(0.01, 0.80), (0.01, 0.0)])


def pick_threshold(table: DataFrame, tries: list[tuple[float, float]]) -> DataFrame:
    """Best F1 among thresholds that meet the first try, else the next; the lowest threshold on ties."""
    rank = F.lit(None).cast("int")
    for i, (p, r) in reversed(list(enumerate(tries))):
        rank = F.when((F.col("precision") >= p) & (F.col("recall") >= r), i).otherwise(rank)
    ranked = table.withColumn("_try", rank).where(F.col("_try").isNotNull())
    return ranked.orderBy("_try", F.desc("f1"), "threshold").limit(1).drop("_try")


def search_threshold(df: DataFrame, label: str, score: str, grid: list[float], tries: list[tuple[float, float]]) -> DataFrame:
    """One row with the chosen threshold; the score's 95th percentile when no try can be met."""
    best = pick_threshold(threshold_table(df, label, score, grid), tries).select("threshold", "precision", "recall", "f1")
    tail = quantiles(df, [], score, {"threshold": 0.95}).select("threshold", *[F.lit(None).cast("double").alias(c) for c in ("precision", "recall", "f1")])
    both = best.withColumn("_r", F.lit(0)).unionByName(tail.withColumn("_r", F.lit(1)))
    return both.orderBy("_r").limit(1).drop("_r")


def search_deviation(df: DataFrame, label: str, score: str, by: str, lo: float = 1.0, hi: float = 5.0, step: float = 0.1,
                     least_recall: float = 0.80) -> DataFrame:
    """Per group, mean + k * deviation of the normal rows' score: best F1 with enough recall, else most recall.

    Without enough recall anywhere the largest k among the most sensitive wins.
    """
    n = int(round((hi - lo) / step)) + 1
    ks = [lo + step * i for i in range(n)]
    base = df.groupBy(by).agg(F.coalesce(F.avg(F.when(F.col(label) == 0, F.col(score))), F.lit(0.0)).alias("_mu"),
                              F.coalesce(F.stddev_pop(F.when(F.col(label) == 0, F.col(score))), F.lit(1.0)).alias("_sd"))
    rows = df.select(by, label, score).join(base, by)
    # Number of multipliers k whose threshold the score exceeds.
    z = F.try_divide(F.col(score) - F.col("_mu"), F.col("_sd"))
    guess = F.when(z.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(n), F.ceil((z - lo) / step).cast("int")))).when(
        F.col(score) > F.col("_mu"), n).otherwise(0)
    steps = F.array(*[F.lit(k) for k in ks])
    limit = lambda i: F.col("_mu") + F.try_element_at(steps, i) * F.col("_sd")
    slot = (F.when((guess < n) & (F.col(score) > limit(guess + 1)), guess + 1)
            .when((guess > 0) & ~(F.col(score) > limit(F.greatest(guess, F.lit(1)))), guess - 1).otherwise(guess))
    counts = rows.groupBy(by, slot.alias("slot")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    grid = base.select(by, "_mu", "_sd", F.posexplode(F.concat(F.array(F.lit(None).cast("double")), steps)).alias("slot", "k"))
    filled = grid.join(counts, [by, "slot"], "left").fillna(0, ["pos", "neg"])
    down = Window.partitionBy(by).orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(by)
    summed = filled.select(by, "k", "_mu", "_sd", F.sum("pos").over(down).alias("tp"), F.sum("neg").over(down).alias("fp"),
                           F.sum("pos").over(whole).alias("_p"), F.sum("neg").over(whole).alias("_n")).where(F.col("k").isNotNull())
    scored = summed.withColumns(rates(F.col("tp"), F.col("fp"), F.col("_p") - F.col("tp"), F.col("_n") - F.col("fp")))
    good = F.col("recall") >= least_recall
    order = F.row_number().over(Window.partitionBy(by).orderBy(
        F.desc(good), F.desc(F.when(good, F.col("f1")).otherwise(F.col("recall"))), F.when(good, F.col("k")).otherwise(-F.col("k"))))
    return (scored.withColumn("_r", order).where(F.col("_r") == 1)
            .select(by, F.col("k").alias("multiplier"), (F.col("_mu") + F.col("k") * F.col("_sd")).alias("threshold"),
                    "precision", "recall", "f1"))


def compare(reports: dict[str, DataFrame]) -> DataFrame:
    """Confusion reports under their names, one row each."""
    out = None
    for name, report in reports.items():
        row = report.select(F.lit(name).alias("model"), "tp", "fp", "fn", "tn", "precision", "recall", "f1", "fpr")
        out = row if out is None else out.unionByName(row)
    return out
