"""Heavy keys: the split forms give what the plain windows give."""

import numpy as np
import pytest
from build import same
from pyspark.sql import functions as F

from tracewell import constants as C
from tracewell.operators import graph, history, links, ml, ordering, profile, roles, stats, structuring


@pytest.fixture
def skewed(tables):
    """A third of all transactions on one account, with tied times."""
    _, t, _ = tables
    heavy = F.when(F.pmod(F.xxhash64("transaction_id"), F.lit(3)) == 0, F.lit("ACC_HOT")).otherwise(F.col("account_id"))
    return t.withColumn("account_id", heavy).withColumn("timestamp", F.date_trunc("hour", "timestamp"))


CASES = {
    "gaps": history.txn_gaps, "rolling": history.rolling, "velocity": history.velocity, "homogeneity": history.homogeneity,
    "past": history.past_stats, "dormancy": history.dormancy, "new": history.new_counterparty, "last_n": history.last_n,
    "types": lambda t: history.type_matches(t, col="transaction_type"), "rule": lambda t: structuring.burst_result(t, window_s=43200),
    "features": structuring.sequence_features, "emit": lambda t: structuring.emit_rows(structuring.label_bursts(t, 43200)),
    "tensor": lambda t: structuring.sequence_tensor(t, ["amount"], 6), "profile": profile.profile_features,
}


@pytest.mark.parametrize("name", ["past", "profile", "types", "rule", "dormancy", "label"])
def test_split_equals_plain_on_null_amounts(skewed, tuned, name):
    """A fifth of the amounts NULL, many times tied."""
    case = {**CASES, "label": lambda t: structuring.label_bursts(t, 43200)}[name]
    holes = skewed.withColumn("amount", F.when(F.pmod(F.xxhash64("transaction_id", F.lit(1)), F.lit(5)) > 0, F.col("amount") / 4))
    plain = case(holes)
    plain.toPandas()
    tuned(hotRows=60, blockRows=25, singleTaskBytes=1)
    same(case(holes), plain, "transaction_id")


def test_label_of_repeated_ids_and_null_amounts(spark, tuned):
    rows = [("ACC", "T1", 30000.0, 0), ("ACC", "T1", 30000.0, 1), ("ACC", "T2", None, 2), ("ACC", "T3", 30000.0, 3), ("ACC", "T4", 100.0, 90)]
    df = spark.createDataFrame([(a, i, m, f"2026-01-01 {h // 60:02d}:{h % 60:02d}:00") for a, i, m, h in rows], "account_id string, transaction_id string, amount double, timestamp string").withColumn("timestamp", F.to_timestamp("timestamp"))
    seen = []
    for hot in (1000, 1):
        tuned(hotRows=hot, singleTaskBytes=1)
        seen.append(sorted((r.transaction_id, r.timestamp, r.is_structuring) for r in structuring.label_bursts(df, 3600).collect()))
    assert seen[0] == seen[1] and [x[2] for x in seen[0]] == [1, 1, 1, 1, 0]


@pytest.mark.parametrize("name", CASES)
def test_split_equals_plain(skewed, tuned, name):
    plain = CASES[name](skewed)
    want = plain.toPandas()
    tuned(hotRows=60, blockRows=25, singleTaskBytes=1)
    got = CASES[name](skewed)
    assert len(want) == len(got.toPandas())
    same(got, plain, "transaction_id")


def test_label_by_running_totals(skewed, tuned):
    def brute(pdf):
        out = {}
        for _, g in pdf.groupby("account_id"):
            ts, amt, ids = g.timestamp.to_numpy(), g.amount.to_numpy(), g.transaction_id.to_numpy()
            flag = np.zeros(len(g), int)
            for i in range(len(g)):
                m = (ts >= ts[i] - np.timedelta64(12, "h")) & (ts <= ts[i])
                if m.sum() >= 3 and (amt[m] < 50000).all() and amt[m].sum() >= 75000:
                    flag[m] = 1
            out.update(zip(ids, flag))
        return out

    light = skewed.withColumn("amount", F.when(F.col("account_id") == "ACC_HOT", F.col("amount") / 4).otherwise(F.col("amount")))
    want = brute(light.toPandas())
    tuned(hotRows=60, singleTaskBytes=1)
    got = {r.transaction_id: r.is_structuring for r in structuring.label_bursts(light, 43200).collect()}
    assert got == want and sum(want.values()) > 20


def test_positions_and_running(skewed, tuned):
    w = ordering.positions(skewed, ["account_id"], ["timestamp", "transaction_id"], "n").toPandas()
    tuned(singleTaskBytes=1)
    spread = ordering.positions(skewed, ["account_id"], ["timestamp", "transaction_id"], "n")
    g = spread.toPandas()
    assert dict(zip(w.transaction_id, w.n)) == dict(zip(g.transaction_id, g.n))
    run = ordering.running(skewed, ["account_id"], ["timestamp", "transaction_id"], {
        "s": ("sum", F.col("amount")), "m": ("max", F.col("amount")), "l": ("last", F.when(F.col("is_fraud") == 1, F.col("amount")))}).toPandas()
    p = run.sort_values(["account_id", "timestamp", "transaction_id"])
    assert np.allclose(p.s, p.groupby("account_id").amount.cumsum())
    assert np.allclose(p.m, p.groupby("account_id").amount.cummax())
    last = p.assign(v=p.amount.where(p.is_fraud == 1)).groupby("account_id").v.ffill()
    assert np.allclose(p.l, last, equal_nan=True)


def test_quantiles_spread(skewed, tuned):
    want = stats.quantiles(skewed, ["account_id"], "amount", {"a": 0.25, "b": 0.5, "c": 0.95}).toPandas()
    tuned(singleTaskBytes=1)
    got = stats.quantiles(skewed, ["account_id"], "amount", {"a": 0.25, "b": 0.5, "c": 0.95})
    g, w = got.toPandas().sort_values("account_id"), want.sort_values("account_id")
    assert np.allclose(g[["a", "b", "c"]], w[["a", "b", "c"]])


def test_previous_value_spread(skewed, tuned):
    want = ordering.previous_value(skewed, ["timestamp", "transaction_id"], "amount", "prev").toPandas()
    tuned(singleTaskBytes=1)
    got = ordering.previous_value(skewed, ["timestamp", "transaction_id"], "amount", "prev").toPandas()
    key = lambda p: p.sort_values("transaction_id").prev.to_numpy()
    assert np.allclose(key(got), key(want), equal_nan=True)


def test_link_joins_against_all_pairs(tables, skewed):
    a = tables[0].withColumn("account_id", F.when(F.pmod(F.xxhash64("event_id"), F.lit(3)) == 0, F.lit("ACC_HOT")).otherwise(F.col("account_id")))
    ap, tp = a.toPandas(), skewed.toPandas()
    both = tp.merge(ap, on="account_id", suffixes=("_t", "_a"))
    gap = (both.timestamp_t - both.timestamp_a).dt.total_seconds()
    want = both[gap.abs() <= 240]
    got = links.temporal_link(a, skewed).select("transaction_id", "access_id").toPandas()
    assert set(zip(got.transaction_id, got.access_id)) == set(zip(want.transaction_id, want.event_id)) and len(got) == len(want)
    near = both[(gap >= 0) & (gap <= 600)].sort_values(["timestamp_a", "event_id"]).groupby("transaction_id").event_id.last().to_dict()
    asof = {r.transaction_id: r.access_id for r in links.asof_access(skewed, a).collect()}
    assert asof == near and len(near) > 5


def test_null_accounts_never_match(spark, tables):
    a, t = (df.withColumn("account_id", F.lit(None).cast("string")) for df in tables[:2])
    assert links.temporal_link(a, t).count() == 0
    assert links.asof_access(t, a).count() == 0


def test_cycles_against_brute_force(spark):
    rng = np.random.default_rng(5)
    pairs = {(f"N{i:02d}", f"N{j:02d}") for i, j in rng.integers(0, 12, (45, 2)) if i != j} | {("N03", f"N{j:02d}") for j in range(12) if j != 3}
    adj = {}
    for s, d in pairs:
        adj.setdefault(s, []).append(d)
    want = set()

    def walk(start, path):
        for n in adj.get(path[-1], []):
            if n == start and 3 <= len(path) <= 6:
                want.add(tuple(path))
            elif n > start and n not in path and len(path) < 6:
                walk(start, [*path, n])

    for s in adj:
        walk(s, [s])
    df = spark.createDataFrame(sorted(pairs), "src string, dst string")
    got = [tuple(r.path) for r in graph.find_cycles(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50
    hub = [tuple(r.path) for r in graph.find_cycles(df, target="N03").collect()]
    assert set(hub) == {c for c in want if "N03" in c} and len(hub) == len(set(hub))
    some = spark.createDataFrame([("N03",), ("N05",)], "s string")
    assert {tuple(r.path) for r in graph.find_cycles(df, target=some).collect()} == {c for c in want if {"N03", "N05"} & set(c)}


def test_nearest_against_brute_force(tables):
    rows = roles.role_features(tables[0]).withColumn("role", F.lit("one"))
    pdf = rows.toPandas()
    x, ids = pdf[C.ROLE_FEATURES].to_numpy(float), pdf.event_id.to_numpy()
    got = ml.nearest(rows, C.ROLE_FEATURES, "role", "event_id", 3, pivots=4).toPandas()
    for i in range(0, len(ids), 7):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        assert np.allclose(np.sort(d)[:3], np.sort(got[got.id == ids[i]].d))


def test_answers_do_not_depend_on_partition_count(spark, tables):
    a, t, _ = tables
    seen = []
    for n in ("1", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        pairs = sorted(tuple(r) for r in links.score_pairs(links.temporal_link(a, t)).select("transaction_id", "access_id", "link_score").collect())
        rings = sorted(tuple(r.path) for r in graph.find_cycles(graph.transfer_digraph(graph.build_edges(a, t))).collect())
        seen.append((pairs, rings))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0] == seen[1]


def test_quantiles_of_many_values_sort_only_those_near_them(spark, monkeypatch):
    sorted_rows, running = [], stats.spread_running

    def counted(df, *rest):
        sorted_rows.append(df.count())
        return running(df, *rest)

    monkeypatch.setattr(stats, "spread_running", counted)
    value = F.when(F.col("id") % 3 == 0, F.lit(0.0)).otherwise(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 7.0 - 40_000.0)
    rows = spark.range(30_000).select(F.when(F.col("id") % 2 == 0, "a").when(F.col("id") % 5 == 0, None).otherwise("b").alias("g"), value.alias("_v"))
    probs = {"least": 0.0, "q25": 0.25, "q50": 0.5, "q99": 0.99, "most": 1.0}
    for by in (["g"], []):
        want = rows.groupBy(*by).agg(*[F.percentile("_v", F.lit(p)).alias(n) for n, p in probs.items()]).collect()
        assert sorted(map(str, stats.spread_quantiles(rows, by, probs).collect())) == sorted(map(str, want))
    assert max(sorted_rows) < 500
    monkeypatch.setattr(stats, "FEW_GROUPS", 0)
    assert sorted(map(str, stats.spread_quantiles(rows, ["g"], probs).collect())) == sorted(map(str, rows.groupBy("g").agg(*[F.percentile("_v", F.lit(p)).alias(n) for n, p in probs.items()]).collect()))
