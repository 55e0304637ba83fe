"""Shapley values of tree ensembles against all subsets."""

import itertools
import math

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from tracewell.operators import ml, shapley

FEATURES = 5


def _tree(rng, depth):
    t = {k: [] for k in ("feature", "cut", "left", "right", "value", "cover")}

    def add(d, cover):
        at = len(t["feature"])
        for k in t:
            t[k].append(0)
        t["cover"][at] = cover
        if d == 0 or rng.random() < 0.1:
            t["feature"][at] = t["left"][at] = t["right"][at] = -1
            t["value"][at] = rng.normal()
        else:
            t["feature"][at], t["cut"][at] = int(rng.integers(FEATURES)), rng.normal()
            part = cover * rng.uniform(0.1, 0.9)
            t["left"][at] = add(d - 1, part)
            t["right"][at] = add(d - 1, cover - part)
        return at

    add(depth, 1000.0)
    return {k: np.array(v, float if k in ("cut", "value", "cover") else int) for k, v in t.items()}


def _expected(t, x, known, node=0):
    f = t["feature"][node]
    if f < 0:
        return t["value"][node]
    left, right = t["left"][node], t["right"][node]
    if f in known:
        return _expected(t, x, known, left if x[f] <= t["cut"][node] else right)
    return (t["cover"][left] * _expected(t, x, known, left) + t["cover"][right] * _expected(t, x, known, right)) / t["cover"][node]


def _brute(trees, x, n=FEATURES):
    game = {known: sum(w * _expected(t, x, known) for w, t in trees) for k in range(n + 1) for known in itertools.combinations(range(n), k)}
    out = np.zeros(n)
    for j in range(n):
        for k in range(n):
            for known in itertools.combinations([i for i in range(n) if i != j], k):
                out[j] += math.factorial(k) * math.factorial(n - k - 1) / math.factorial(n) * (game[tuple(sorted((*known, j)))] - game[known])
    return game[()], out


def test_values_are_those_of_all_subsets():
    rng = np.random.default_rng(0)
    for depth in (0, 1, 3, 7):
        trees = [(rng.uniform(0.1, 1), _tree(rng, depth)) for _ in range(3)]
        base, groups = shapley.compiled(trees)
        x = rng.normal(size=(6, FEATURES))
        x[0, 2] = np.nan  # goes right at every split, as in the trees
        for row, got in zip(x, shapley.shapley(x, groups)):
            want_base, want = _brute(trees, row)
            assert abs(base - want_base) < 1e-12 and np.abs(got - want).max() < 1e-12


def test_path_changes_are_not_shapley_values():
    """x0 and x1: a game where the change along the path gives all to the feature that is asked last."""
    tree = {"feature": np.array([0, -1, 1, -1, -1]), "cut": np.array([0.0, 0, 0, 0, 0]), "left": np.array([1, -1, 3, -1, -1]), "right": np.array([2, -1, 4, -1, -1]),
            "value": np.array([0.0, 0, 0, 0, 1]), "cover": np.array([4.0, 2, 2, 1, 1])}
    _, groups = shapley.compiled([(1.0, tree)])
    assert np.allclose(shapley.shapley(np.array([[1.0, 1.0]]), groups), [[0.375, 0.375]])


def test_fitted_ensembles(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 4))
    y = x[:, 0] * x[:, 1] + np.where(x[:, 2] > 0, x[:, 3], 0)
    cols = ["a", "b", "c", "d"]
    df = spark.createDataFrame([(k, *map(float, r), float(v)) for k, (r, v) in enumerate(zip(x, y))], "id long, a double, b double, c double, d double, y double")
    for last in (GBTRegressor(labelCol="y", maxIter=4, maxDepth=4, seed=1), RandomForestRegressor(labelCol="y", numTrees=3, maxDepth=4, seed=1)):
        model = Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="features"), last]).fit(df)
        path = str(tmp_path / model.stages[-1].uid)
        ml.save_model(model, path, {})
        trees = shapley.saved_ensemble(spark, model, f"{path}/model")
        scale = 1 / sum(w for w, _ in trees) if isinstance(last, RandomForestRegressor) else 1.0  # a forest averages
        got = model.transform(shapley.attribute(df, trees, cols)).orderBy("id").toPandas()
        values = np.stack(got["attributions"].to_list())
        assert np.allclose((got["base_value"] + values.sum(1)) * scale, got["prediction"])
        for k in (0, 17, 399):
            assert np.allclose(values[k], _brute(trees, x[k], 4)[1])


def test_no_rows_and_constant_trees(spark):
    leaf = {"feature": np.array([-1]), "cut": np.zeros(1), "left": np.array([-1]), "right": np.array([-1]), "value": np.array([0.5]), "cover": np.ones(1)}
    df = spark.createDataFrame([(None,), (1.0,)], "a double")
    got = shapley.attribute(df, [(2.0, leaf)], ["a"]).collect()
    assert [(r.base_value, r.attributions) for r in got] == [(1.0, [0.0])] * 2
    assert shapley.attribute(df.where(F.lit(False)), [(2.0, leaf)], ["a"]).count() == 0
