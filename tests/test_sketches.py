"""Merged sketches against exact answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.operators import sketches as S


def _rows(spark):
    rng = np.random.default_rng(8)
    values = np.concatenate([rng.lognormal(3, 2, 3000), -rng.lognormal(0, 1, 300), np.zeros(40), [1e-300, 1e300]])
    rows = [(f"2026-01-{1 + k % 9:02d} 10:00:00", "ab"[k % 7 == 0], float(v), k % 1500) for k, v in enumerate(values)]
    return spark.createDataFrame([*rows, ("2026-01-01 10:00:00", "a", None, None), ("2026-01-01 10:00:00", "a", float("nan"), 1)], "t string, g string, v double, who long").withColumn("timestamp", F.to_timestamp("t"))


@pytest.mark.parametrize("first,last", [(None, None), ("2026-01-03", "2026-01-05")])
def test_quantiles_are_within_the_bound(spark, first, last):
    df = _rows(spark)
    shares = [0.0, 0.01, 0.5, 0.9, 0.999, 1.0]
    got = {(r.g, r.share): r.value for r in S.quantiles(S.daily_values(df, ["g"], "v"), ["g"], shares, first, last).collect()}
    rows = [r for r in df.collect() if r.v is not None and r.v == r.v and (first is None or first <= r.t[:10] <= last)]
    for g in "ab":
        x = sorted(r.v for r in rows if r.g == g)
        for s in shares:
            want = x[max(1, int(np.ceil(s * len(x)))) - 1]
            assert abs(got[g, s] - want) <= S.ALPHA * abs(want) * (1 + 1e-9), (g, s)


def test_merging_in_any_order_gives_the_same(spark):
    df = _rows(spark)
    stored, whole = S.daily_values(df, ["g"], "v"), S.daily_values(df.withColumn("timestamp", F.lit("2026-01-01").cast("timestamp")), ["g"], "v")
    show = lambda t: sorted(map(tuple, S.quantiles(t, ["g"], [0.1, 0.5, 0.9]).collect()))
    assert show(stored) == show(stored.repartition(7)) == show(stored.orderBy(F.desc("day"))) == show(whole)
    one = S.daily_distinct(df, ["g"], "who")
    twice = one.unionByName(one)
    counts = lambda t: sorted(map(tuple, S.distinct(t, ["g"]).collect()))
    assert counts(one) == counts(one.repartition(5)) == counts(one.orderBy(F.desc("day"))) == counts(twice)


def test_distinct_counts_are_within_the_bound(spark):
    df = spark.range(60000).select(F.to_timestamp(F.concat(F.lit("2026-01-0"), (F.col("id") % 5 + 1).cast("string"))).alias("timestamp"), (F.col("id") % 3).alias("g"), (F.col("id") % 20011).alias("who"))
    exact = {r.g: r.n for r in df.groupBy("g").agg(F.countDistinct("who").alias("n")).collect()}
    for r in S.distinct(S.daily_distinct(df, ["g"], "who"), ["g"]).collect():
        assert abs(r.n_distinct - exact[r.g]) <= S.DISTINCT_ERROR * exact[r.g]
    assert S.distinct(S.daily_distinct(df.limit(0), ["g"], "who"), ["g"]).count() == 0
