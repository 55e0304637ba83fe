"""Networks trained on Spark: gradients against finite differences, sums against one task, what they learn."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tracewell.operators import ml, nets


def _numeric(f, w, name, at, eps=1e-6):
    up, down = ({k: v.copy() for k, v in w.items()} for _ in range(2))
    up[name][at] += eps
    down[name][at] -= eps
    return (f(up) - f(down)) / (2 * eps)


def _close(f, w, grads, rng):
    for name in w:
        for _ in range(12):
            at = tuple(int(rng.integers(n)) for n in w[name].shape)
            assert abs(_numeric(f, w, name, at) - grads[name][at]) < 1e-5 * (1 + abs(grads[name][at])), (name, at)


def test_sequence_gradients_are_finite_differences():
    rng = np.random.default_rng(0)
    w = nets.sequence_weights(3, hidden=5, attention=4, seed=1)
    x, y, rw = rng.normal(size=(7, 6, 3)), (rng.random(7) < 0.5).astype(float), rng.uniform(0.5, 2, 7)
    _close(lambda v: nets.sequence_gradient(v, x, y, rw)[0], w, nets.sequence_gradient(w, x, y, rw)[2], rng)


def test_group_gradients_are_finite_differences():
    rng = np.random.default_rng(0)
    w = nets.group_weights(3, 5, 4, 2, seed=1)
    w = {k: v + rng.normal(0, 0.1, v.shape) for k, v in w.items()}
    x, g = rng.normal(size=(9, 5)), rng.integers(0, 3, 9)
    _close(lambda v: nets.group_gradient(v, x, g)[0], w, nets.group_gradient(w, x, g)[2], rng)


def _order_dependent(spark, n=600, length=8, parts=4):
    """Positive if a spike of the second feature comes right after one of the first, wherever; no weighting of steps tells that."""
    rng = np.random.default_rng(4)
    rows = []
    for k in range(n):
        y = int(rng.random() < 0.5)
        a, b = rng.choice(length, 2, replace=False)
        while (b == a + 1) != bool(y):
            a, b = rng.choice(length, 2, replace=False)
        x = rng.normal(0, 0.1, (length, 2))
        x[a, 0] += 2
        x[b, 1] += 2
        rows.append((k, x.tolist(), y))
    return spark.createDataFrame(rows, "id long, sequence array<array<double>>, label int").repartition(parts, "id")


def _right(scored, name):
    return scored.agg(F.avg(((F.col(name) > 0.5).cast("int") == F.col("label")).cast("double"))).head()[0]


def test_sequence_model_sees_order_where_the_logistic_model_does_not(spark):
    df = _order_dependent(spark)
    train, test = df.where("id % 3 > 0").cache(), df.where("id % 3 = 0").cache()
    weights, losses = nets.fit_sequences(train, "sequence", "label", 8, 2, hidden=8, steps=90, rate=0.05, seed=3)
    scored = nets.score_sequences(test, weights, "sequence", 8)
    linear = ml.probability(ml.fit_sequence(train), ml.flat_sequence(test), "p")
    assert losses[-1] < 0.3 * losses[0]
    assert _right(scored, "probability") > 0.93 > 0.8 > _right(linear, "p")
    assert all(abs(sum(r.attention) - 1) < 1e-9 for r in scored.limit(5).collect())


def test_sums_do_not_depend_on_the_number_of_tasks(spark, monkeypatch):
    df = _order_dependent(spark, 60)
    w = nets.sequence_weights(2, 4, 3)

    def loss(v, batch):
        return nets.sequence_gradient(v, nets._sequences(batch, "sequence", 8), nets._column(batch, "label"), np.ones(len(batch)))

    whole = nets.gradient(df.coalesce(1), w, loss)
    monkeypatch.setattr(nets, "FLAT", 4)
    again = [nets.gradient(df.repartition(9, "id"), w, loss) for _ in range(2)]
    assert np.array_equal(nets.packed(again[0][2]), nets.packed(again[1][2]))  # the same to the last bit
    assert again[0][1] == whole[1] == 60 and np.allclose(nets.packed(again[0][2]), nets.packed(whole[2]))
    assert nets.gradient(df.limit(0), w, loss)[1] == 0


def test_group_networks_learn_their_own_groups(spark):
    """Two groups on two curved lines in four dimensions; a point of the other group's line is given back badly."""
    rng = np.random.default_rng(2)
    t = rng.uniform(-1, 1, 500)
    a, b = np.stack([t, t**2, t, -t], 1), np.stack([t, -t, t**2, t**3], 1)
    rows = [(k, "a" if k % 2 else "b", *map(float, (a if k % 2 else b)[k])) for k in range(500)]
    schema = "id long, g string, w double, x double, y double, z double"
    df, cols = spark.createDataFrame(rows, schema).repartition(3, "id").cache(), ["w", "x", "y", "z"]
    model = nets.fit_groups(df, cols, "g", steps=120, rate=0.03)
    assert model["names"] == ["a", "b"] and model["losses"][-1] < 0.1 * model["losses"][0]
    own = nets.group_errors(df, model, "g").agg(F.avg("fitted_error")).head()[0]
    other = nets.group_errors(df.withColumn("g", F.when(F.col("g") == "a", "b").otherwise("a")), model, "g").agg(F.avg("fitted_error")).head()[0]
    assert other > 5 * own
    odd = spark.createDataFrame([(1, "c", 1.0, 1.0, 1.0, 1.0), (2, None, 1.0, 1.0, 1.0, 1.0), (3, "a", None, 0.1, 0.1, 0.1)], schema)
    got = {r.id: r for r in nets.group_errors(odd, model, "g").collect()}
    assert got[1].fitted_error is None and got[2].err_x is None and got[3].fitted_error is not None
    assert abs(got[3].fitted_error - np.mean([got[3][f"err_{c}"] for c in cols])) < 1e-12
    empty = nets.fit_groups(df.limit(0), cols, "g")
    assert nets.group_errors(odd, empty, "g").where("fitted_error is null").count() == 3


def test_missing_numbers_count_as_zero():
    batch = pa.RecordBatch.from_pydict({"s": pa.array([[[1.0, None], [2.0, 3.0]]], pa.list_(pa.list_(pa.float64())))})
    assert nets._sequences(batch, "s", 2).tolist() == [[[1.0, 0.0], [2.0, 3.0]]]


def test_a_step_goes_over_the_rows_once(spark):
    df = _order_dependent(spark, 60)
    w = nets.sequence_weights(2, 4, 3)
    seen = spark.sparkContext.accumulator(0)

    def loss(v, batch):
        seen.add(len(batch))
        return nets.sequence_gradient(v, nets._sequences(batch, "sequence", 8), nets._column(batch, "label"), np.ones(len(batch)))

    assert nets.gradient(df.repartition(5, "id"), w, loss)[1] == 60
    assert seen.value == 60


def test_long_batches_are_cut_and_summed():
    rng = np.random.default_rng(0)
    w = nets.sequence_weights(3, hidden=5, attention=4, seed=1)
    n = 2 * nets.ROWS + 3
    x, y, rw = rng.normal(size=(n, 6, 3)), (rng.random(n) < 0.5).astype(float), rng.uniform(0.5, 2, n)
    value, weight, grads = nets.sequence_gradient(w, x, y, rw)
    parts = [nets.sequence_gradient(w, x[k : k + 50], y[k : k + 50], rw[k : k + 50]) for k in range(0, n, 50)]
    assert np.isclose(value, sum(p[0] for p in parts)) and np.isclose(weight, rw.sum())
    assert all(np.allclose(grads[k], sum(p[2][k] for p in parts)) for k in w)
