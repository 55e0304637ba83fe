from collections import Counter

import numpy as np
import pytest
from build import txns
from pyspark.sql import functions as F

from tracewell import constants as C
from tracewell.operators import embedding as E
from tracewell.operators import evaluate as V
from tracewell.operators import forest, graph, ml, profile, roles


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(3)
    y = (rng.random(900) < 0.2).astype(int)
    s = np.round(np.clip(rng.normal(0.4 + 0.25 * y, 0.2), 0, 1), 2)
    df = spark.createDataFrame([(i, float(a), int(b)) for i, (a, b) in enumerate(zip(s, y))], "event_id long, s double, y int")
    return df, s, y


def test_confusion_with_empty_denominators(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "y int, p int")
    r = V.confusion(df, "y", "p").head()
    assert (r.tp, r.fp, r.fn, r.tn, r.precision, r.recall, r.f1, r.fpr, r.fnr) == (0, 0, 0, 2, 0, 0, 0, 0, 0)


def test_curve_areas(scored, tuned):
    df, s, y = scored
    pos, neg = s[y == 1], s[y == 0]
    auc = np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :]))
    got = V.curve_areas(V.curves(df, "y", "s")).head()
    assert got.roc_auc == pytest.approx(auc)
    tuned(singleTaskBytes=1)
    again = V.curve_areas(V.curves(df, "y", "s")).head()
    assert again.roc_auc == pytest.approx(auc) and again.average_precision == pytest.approx(got.average_precision)


@pytest.mark.parametrize("strict", [False, True])
def test_threshold_table(scored, strict):
    df, s, y = scored
    grid = V.linspace(0.10, 0.90, 81)
    rows = {round(r.threshold, 6): r for r in V.threshold_table(df, "y", "s", grid, strict).collect()}
    for g in grid:
        p = s > g if strict else s >= g
        r = rows[round(g, 6)]
        assert (r.tp, r.fp, r.fn, r.tn) == tuple(int(x) for x in ((p & (y == 1)).sum(), (p & (y == 0)).sum(), (~p & (y == 1)).sum(), (~p & (y == 0)).sum()))


def test_search_falls_back_to_the_95th_percentile(spark):
    df = spark.createDataFrame([(float(i), 0) for i in range(101)], "s double, y int")
    assert V.search_threshold(df, "y", "s", *V.PROFILE_SEARCH).head().threshold == pytest.approx(95.0)


def test_deviation_search(scored, spark):
    df, s, y = scored
    got = V.search_deviation(df.withColumn("g", F.lit("g")), "y", "s", "g").head()
    mu, sd, best = s[y == 0].mean(), s[y == 0].std(), None
    table = []
    for i in range(41):
        k = 1.0 + 0.1 * i
        p = s > mu + k * sd
        tp, fp, fn = (p & (y == 1)).sum(), (p & (y == 0)).sum(), (~p & (y == 1)).sum()
        table.append((k, tp / (tp + fn), 2 * tp / max(1, 2 * tp + fp + fn)))
    good = [t for t in table if t[1] >= 0.8]
    best = max(good, key=lambda t: (t[2], -t[0])) if good else max(table, key=lambda t: (t[1], t[0]))
    assert got.multiplier == pytest.approx(best[0]) and got.threshold == pytest.approx(mu + best[0] * sd)


def test_splits(tables):
    _, t, _ = tables
    n = t.count()
    rows = ml.time_split(t, val_frac=0.8).groupBy("split").agg(F.count("*").alias("n"), F.max("timestamp").alias("hi"), F.min("timestamp").alias("lo"))
    got = {r.split: r for r in rows.collect()}
    train = int(0.8 * n)
    assert (got["test"].n, got["train"].n, got["val"].n) == (n - train, int(0.8 * train), train - int(0.8 * train))
    assert got["train"].hi < got["val"].lo and got["val"].hi < got["test"].lo
    split = ml.account_split(t, "is_fraud").select("account_id", "split").distinct()
    assert split.groupBy("account_id").count().where("count > 1").count() == 0


def test_oversample_reaches_the_ratio(tables):
    _, t, _ = tables
    got = {r.is_fraud: r["count"] for r in ml.oversample(t, "is_fraud").groupBy("is_fraud").count().collect()}
    assert got[1] == got[0] // 5


def test_jitter_is_repeatable_and_bounded(tables):
    a = tables[0]
    one, two = (sorted(map(tuple, ml.jitter(a.repartition(n)).select("event_id", "copy", "records_accessed", "timestamp").collect())) for n in (1, 5))
    assert one == two and min(r[2] for r in one) >= 1


def test_smote_points_lie_between_positives(tables):
    rows = roles.role_features(tables[0]).withColumn("role", F.lit("one")).withColumn("y", (F.col("records_accessed") == 5).cast("int"))
    cols = ["records_accessed", "hour_of_day", "day_of_week"]
    out = ml.smote(rows, cols, "y", "role", share=0.5).toPandas()
    n_pos, n_neg = rows.where("y = 1").count(), rows.where("y = 0").count()
    assert len(out) == max(int(0.5 * n_neg), n_pos) - n_pos
    assert (out.records_accessed == 5).all() and out.hour_of_day.between(0, 23).all()


def test_forest_ranks_outliers_first(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(0, 1, (600, 2)), rng.normal(9, 0.5, (6, 2))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "event_id long, a double, b double")
    model = forest.IsolationForest(["a", "b"], trees=60).fit(df, ["event_id"])
    top = {r.event_id for r in model.score(df).orderBy(F.desc("forest_score")).limit(6).collect()}
    assert top == set(range(600, 606))
    share = model.score(df).agg(F.avg("is_outlier")).head()[0]
    assert 0.03 < share < 0.07


def test_role_errors_match_numpy(tables):
    rows = roles.role_features(tables[0]).na.fill(0.0)
    out = ml.role_errors(rows, ml.fit_role_baseline(rows)).where("role = 'it_admin'").toPandas().sort_values("event_id")
    x = out[C.ROLE_FEATURES].to_numpy(float)
    lo, hi = x.min(0), x.max(0)
    z = (x - lo) / np.where(hi > lo, hi - lo, 1.0)
    c = z - z.mean(0)
    axes = np.linalg.eigh(np.cov(c.T, bias=True))[1][:, ::-1][:, :4]
    want = ((c - c @ axes @ axes.T) ** 2).mean(1)
    assert np.allclose(out.fitted_error, want, atol=1e-8)


def test_tree_attributions_add_up(tables, spark, tmp_path):
    rows = profile.profile_features(tables[2])
    model = ml.fit_profile(rows, trees=3, depth=3)
    ml.save_model(model, str(tmp_path / "m"), {"columns": C.PROFILE_FEATURES})
    model, settings = ml.load_model(spark, str(tmp_path / "m"))
    assert settings["columns"] == C.PROFILE_FEATURES
    parts = ml.attribute_trees(model, rows).toPandas().set_index("txn_key")
    total = parts.base_value + parts.attributions.map(sum)
    prob = ml.probability(model, rows, "p").toPandas().set_index("txn_key").p
    assert np.allclose(1 / (1 + np.exp(-2 * total)), prob.loc[total.index])
    assert all(len(x) == 3 for x in parts.top_features)


def test_walks_follow_edges_and_repeat(spark):
    t = txns(spark, *[{"account_id": f"ACC_{i}", "counterparty_id": f"ACC_{(i + 1) % 6}", "timestamp": "2026-01-01 00:00:00"} for i in range(6)])
    edges = graph.build_edges(t.where("false").select(F.lit(1).alias("event_id"), F.lit("").alias("employee_id"), "account_id", "timestamp", F.lit("").alias("action_type"),
                                                      F.lit(1).alias("records_accessed"), F.lit(0).alias("is_suspicious")), t)
    walks = E.random_walks(edges, n=3, length=7)
    rows = sorted(tuple(r.path) for r in walks.collect())
    assert len(rows) == 18 and all(len(p) == 7 for p in rows)
    assert all(abs(int(a[4:]) - int(b[4:])) in (1, 5) for p in rows for a, b in zip(p, p[1:]))
    assert rows == sorted(tuple(r.path) for r in E.random_walks(edges.repartition(3), n=3, length=7).collect())


def test_forest_draws_equal_rows_as_often_as_they_stand(spark):
    rows = spark.range(20000).select(F.xxhash64("id").alias("_id"), F.when(F.col("id") % 2 == 0, 1.0).otherwise(F.col("id").cast("double")).alias("a"))
    drawn = forest.IsolationForest(["a"], trees=20, sample=256).drawn(rows, 20000).toPandas()
    for _, tree in drawn.groupby("tree"):
        assert len(tree) >= 256 and 0.35 < (tree.sort_values("_h").head(256).a == 1.0).mean() < 0.65


def test_embedding_puts_ring_neighbours_together(spark):
    pairs = [(f"ACC_{g}{i}", f"ACC_{g}{j}") for g in "AB" for i in range(5) for j in range(5) if i != j]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    walks = E.random_walks(edges, n=8, length=8)
    vecs = E.embed(walks, dim=8)
    near = [r.account_id for r in E.similar(vecs, "ACC_A0", k=4, min_sim=-1.0).collect()]
    assert vecs.count() == 10 and sum(n.startswith("ACC_A") for n in near) >= 3


def test_cosine_edge_cases(spark):
    df = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0, 1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(E.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, -1.0, 0.0, 0.0]


def test_pairs_of_walks_are_counted_from_both_ends_and_the_walks_read_once_for_the_factors(spark):
    paths = [["a", "b", "a", None, "c", "a", "a"], [], None, ["z"], [None, None, "a", "b", "c", "d", "e", "f"]]
    for window in (1, 3, 20):
        want = Counter((p[i], p[j]) for p in paths if p for i in range(len(p)) for j in range(len(p)) if i != j and abs(i - j) <= window)
        got = E.cooccurrence(spark.createDataFrame([(p,) for p in paths], "path array<string>"), window).collect()
        assert len(got) == len(want) and {(r.a, r.b): r.n for r in got} == want
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = [(f"n{k}", w, [f"n{(k + i * w) % 12}" for i in range(6)]) for k in range(12) for w in (1, 2)]
    walks = spark.createDataFrame(rows, "start string, walk int, path array<string>").mapInArrow(seen, "start string, walk int, path array<string>")
    vecs = E.embed(walks, dim=4).collect()
    assert len(vecs) == 12 and all(len(v.vec) == 4 for v in vecs)
    assert read.value == 2 * len(rows)  # once for the nodes' numbers, once for the pairs


def test_a_split_works_its_rows_out_once_when_they_are_stored(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = spark.range(300).select(F.col("id").cast("string").alias("transaction_id"), F.timestamp_seconds("id").alias("timestamp"), F.col("id").alias("n"))
    spark.conf.set("spark.tracewell.singleTaskBytes", "1")
    try:
        split = ml.time_split(rows.mapInArrow(seen, rows.schema), val_frac=0.8).groupBy("split").agg(F.count("*").alias("n"), F.max("n").alias("hi")).collect()
    finally:
        spark.conf.unset("spark.tracewell.singleTaskBytes")
    assert {r.split: (r.n, r.hi) for r in split} == {"train": (192, 191), "val": (48, 239), "test": (60, 299)}
    assert read.value <= 2 * 300  # for the cut points and for the rows, not once more for their number
