"""Neighbour joins against brute force, and the pairs they look at."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.operators import neighbours as N


def _frame(spark, x, groups, parts=3):
    dims = len(x[0])
    rows = [(k, g, *[None if v is None else float(v) for v in r]) for k, (g, r) in enumerate(zip(groups, x))]
    return spark.createDataFrame(rows, "id long, g string, " + ", ".join(f"c{i} double" for i in range(dims))).repartition(parts), [f"c{i}" for i in range(dims)]


def _brute(x, groups, k):
    out = []
    for i, (g, a) in enumerate(zip(groups, x)):
        if any(v is None for v in a):
            continue
        others = sorted((float(np.sqrt(sum((p - q) ** 2 for p, q in zip(a, b)))), j) for j, (h, b) in enumerate(zip(groups, x)) if j != i and h == g and all(v is not None for v in b))
        out += [(g, i, j, round(d, 9), r + 1) for r, (d, j) in enumerate(others[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("k,pivots", [(1, 64), (5, 7), (3, 1)])
def test_neighbours_are_exact(spark, k, pivots):
    rng = np.random.default_rng(3)
    x = [list(map(float, r)) for r in (rng.normal(size=(160, 3)) * 4).round() / 4]  # sums of squares are exact, so ties are ties
    x[4], x[5][1] = x[3], None
    x[60:90] = [x[60]] * 30  # copies
    groups = [rng.choice(["a", "a", "a", "b", None]) for _ in x[:-1]] + ["alone"]
    df, cols = _frame(spark, x, groups)
    got = sorted(((r.g, r.id, r.other, round(r.d, 9), r["rank"]) for r in N.nearest(df, cols, "g", "id", k, pivots).collect()), key=str)
    assert got == _brute(x, groups, k)


def test_no_rows_and_one_row(spark):
    df, cols = _frame(spark, [[1.0, 2.0]], ["a"])
    assert N.nearest(df, cols, "g", "id").count() == 0 and N.nearest(df.limit(0), cols, "g", "id").count() == 0


def test_pairs_stay_few_where_the_diagonal_tells_nothing(spark):
    """Clusters on the plane x + y = 0: every row has the same projection on the diagonal. A third of the rows are one point."""
    rng = np.random.default_rng(5)
    centre = np.repeat(rng.uniform(-100, 100, 60), 20)
    t = centre + rng.normal(size=1200) * 0.5
    x = np.stack([t, -t], 1)
    x[:400] = x[0]
    df, cols = _frame(spark, x, ["g"] * 1200)
    points = df.select("g", F.array(*[F.col(c) for c in cols]).alias("x")).distinct().withColumn("v", F.monotonically_increasing_id())
    placed, summary = N.cells(points, "g", 5)
    pairs = N.candidates(placed, summary, "g", 5).count()
    assert points.count() > 800 and pairs < 801 * 60  # of 640 000
    near = N.nearest(df, cols, "g", "id", 5).where("id >= 400").collect()
    for r in [r for r in near if r.id % 97 == 0]:
        assert abs(r.d - np.sort(np.linalg.norm(x - x[r.id], axis=1))[r["rank"]]) < 1e-9


def _recall(got, x, ids, k=5, floor=0.5):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = total = 0
    for i in ids:
        sims = np.round(unit @ unit[i], 9)
        sims[i] = -2
        best = np.sort(sims)[::-1][:k]
        want = [s for s in best if s >= floor]
        mine = sorted((round(s, 9) for s in got.get(i, [])), reverse=True)
        total += len(want)
        hit += sum(1 for s in mine if want and s >= want[-1] - 1e-9)
    return hit / total


def test_recall_at_five_of_the_hyperplane_index(spark):
    """Measured: over 0.95 on communities, with near copies (a third of the rows) as one heavy bucket."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1500, 16)) * 0.45 + np.repeat(rng.normal(size=(75, 16)), 20, axis=0)
    x[:500] = x[0] + rng.normal(size=(500, 16)) * 1e-3
    x[600:640] = x[600]
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "id long, vec array<double>").repartition(4)
    rows = N.similar_all(df, 5, limit=64).collect()
    got = {}
    for r in rows:
        got.setdefault(r.id, []).append(r.similarity)
        assert r.id != r.other
    assert max(len(v) for v in got.values()) <= 5
    recalls = [_recall(got, x, part) for part in (range(0, 500, 7), range(500, 1500, 7))]
    assert min(recalls) >= 0.9, recalls


def test_similarities_are_exact_and_copies_come_first(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [3.0, 0.0]), (4, [1.0, 1.0]), (5, [0.0, 0.0]), (6, None), (7, [None, 1.0]), (8, [-1.0, 0.0])], "id long, vec array<double>")
    got = sorted(tuple(r) for r in N.similar_all(df, 2, tables=8).select("id", "rank", "other", F.round("similarity", 6).alias("s")).collect())
    assert got == [(1, 1, 2, 1.0), (1, 2, 3, 1.0), (2, 1, 1, 1.0), (2, 2, 3, 1.0), (3, 1, 1, 1.0), (3, 2, 2, 1.0), (4, 1, 1, 0.707107), (4, 2, 2, 0.707107)]
    assert N.similar_all(df.limit(0), 2).count() == 0


def test_heavy_buckets_are_split(spark):
    signed = spark.range(1000).select(F.col("id").alias("v"), F.lit(0).alias("table"), F.when(F.col("id") < 700, "0" * N.BITS).otherwise(F.lpad(F.bin("id"), N.BITS, "1")).alias("bits"))
    sizes = [r["count"] for r in N.buckets(signed, 50).groupBy("table", "bucket").count().collect()]
    assert sum(sizes) == 1000 and max(sizes) <= 90


def test_buckets_grow_until_enough_is_found(spark):
    """Vectors without structure: small buckets find little, which the probes show."""
    x = np.random.default_rng(9).normal(size=(600, 24))
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "id long, vec array<double>")
    recalls = []
    for wanted in (0.0, 0.9):
        got = {}
        for r in N.similar_all(df, 5, min_sim=0.0, limit=8, at_least=wanted).collect():
            got.setdefault(r.id, []).append(r.similarity)
        recalls.append(_recall(got, x, range(0, 600, 5), floor=0.0))
    assert recalls[0] < 0.7 and recalls[1] >= 0.88, recalls


def test_buckets_are_gone_over_in_tiles_and_asked_rows_only(spark, monkeypatch):
    """Small tiles and blocks give what whole buckets give; pairs that go on are a few of each bucket, not all of its pairs."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 12))
    x[250:] = x[:50]
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "id long, vec array<double>").repartition(3)
    get = lambda **o: {(r.id, r.rank): (r.other, round(r.similarity, 9)) for r in N.similar_all(df, 5, min_sim=0.0, limit=512, **o).collect()}
    whole = get()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(0, 300, 20):
        sims = unit @ unit[i]
        sims[i] = -2
        best = sorted(range(300), key=lambda w: (-round(sims[w], 9), w))[:5]
        assert [whole[i, k][0] for k in range(1, 6)] == best
    monkeypatch.setattr(N, "TILE", 20)
    monkeypatch.setattr(N, "BLOCK", 7)
    assert get() == whole
    assert get(asked="id % 20 = 0") == {key: v for key, v in whole.items() if key[0] % 20 == 0}
    points = spark.createDataFrame([(k, r.tolist(), [k]) for k, r in enumerate(unit)], "v long, u array<double>, ids array<long>")
    placed = points.select("v", F.lit(0).alias("table"), F.lit("").alias("bucket"))
    assert N._judged(placed, points, points, 2, -1.0).groupBy("v").count().agg(F.max("count")).head()[0] < 300


def test_points_are_dealt_to_all_tasks_and_plain_distances_are_the_same(spark):
    """Few bytes are much work here: the points must not end up in one task, nor the pairs they are asked for."""
    points = spark.range(600).select((F.col("id") % 2).alias("g"), F.col("id").alias("v"), F.array(*[F.sin(F.col("id") * (i + 1)) for i in range(3)]).alias("x"))
    placed, summary = N.cells(points, "g", 5)
    assert len({r[0] for r in placed.select(F.spark_partition_id()).collect()}) > 1
    assert "BroadcastHashJoin" in placed.join(summary, "g")._jdf.queryExecution().executedPlan().toString()
    pairs = N.candidates(placed, summary, "g", 5).select(N.distance(F.col("x"), F.col("other_x")).alias("a"), N.distance(F.col("x"), F.col("other_x"), 3).alias("b"))
    assert pairs.where("a is distinct from b").count() == 0 and pairs.count() > 600
