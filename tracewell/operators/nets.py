"""Small neural models trained on Spark: gradients are worked out where the rows are, and summed.

A step broadcasts the weights, a task goes over its rows and hands on one row, the sum of its gradients, and these are added up in a tree
whose first level is made of as many tasks as the root of their number. The driver sees weights and gradients only, never a
training row. A step may take a share of the rows, chosen by a hash, so that its cost does not grow with the table.

Two models: a recurrent network with attention pooling over sequences, and bottleneck networks that learn to give back the normal
rows of their group, one for each group, all in the same pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Weights = dict[str, np.ndarray]
Loss = Callable[[Weights, pa.RecordBatch], tuple[float, float, Weights]]  # sum of losses, sum of row weights, gradients

PARTIAL = "part int, loss double, n double, gradient binary"
FLAT = 64  # partial sums that go to the driver as they are; more are added up on the way
ROWS = 512  # sequences gone over at a time


def packed(weights: Weights) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in sorted(weights)])


def unpacked(flat: np.ndarray, like: Weights) -> Weights:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def _added(batches: Iterator[pa.RecordBatch]) -> tuple[float, float, np.ndarray | None]:
    loss, n, total = 0.0, 0.0, None
    for batch in batches:
        for row in batch.to_pylist():
            part = np.frombuffer(row["gradient"])
            loss, n, total = loss + row["loss"], n + row["n"], part.copy() if total is None else total + part
    return loss, n, total


def gradient(rows: DataFrame, weights: Weights, loss: Loss) -> tuple[float, float, Weights]:
    """(sum of losses, sum of weights, summed gradients) over all rows; sums are made in a fixed order, so runs agree."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, value, n = shared.value, None, 0.0, 0.0
        for batch in batches:
            if len(batch):
                one, many, grads = loss(now, batch)
                value, n, total = value + one, n + many, packed(grads) if total is None else total + packed(grads)
        if total is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "loss": [value], "n": [n], "gradient": [total.astype(np.float64).tobytes()]})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, n, total = _added(batches)
        if total is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "loss": [value], "n": [n], "gradient": [total.tobytes()]})

    parts = rows.mapInArrow(local, PARTIAL)
    tasks = rows.rdd.getNumPartitions()
    if tasks > FLAT:
        groups = int(np.sqrt(tasks))
        parts = parts.repartition(groups, F.pmod("part", F.lit(groups))).sortWithinPartitions("part").mapInArrow(merge, PARTIAL)
    # Put in order here: an ORDER BY would work out the gradients twice, once to find its ranges.
    value, n, total = _added(iter(parts.toArrow().sort_by("part").to_batches()))
    shared.unpersist()
    return value, n, unpacked(total if total is not None else np.zeros(packed(weights).size), weights)


def descend(rows: DataFrame, weights: Weights, loss: Loss, steps: int = 60, rate: float = 0.02, share: int = 1, unique: str | None = None) -> tuple[Weights, list[float]]:
    """Weights after ``steps`` steps of Adam, and the mean loss before each. ``share``: a step takes one of so many rows, by hash of ``unique``."""
    first, second = np.zeros(packed(weights).size), np.zeros(packed(weights).size)
    at, losses = packed(weights), []
    for k in range(1, steps + 1):
        some = rows if share == 1 else rows.where(F.pmod(F.xxhash64(unique), F.lit(share)) == k % share)
        value, n, grads = gradient(some, unpacked(at, weights), loss)
        if n == 0:
            continue
        g = packed(grads) / n
        losses.append(value / n)
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        at = at - rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-8)
    return unpacked(at, weights), losses


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(float)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


# ---- sequences: a recurrent network with attention pooling


def sequence_weights(features: int, hidden: int = 16, attention: int = 8, seed: int = 42) -> Weights:
    rng = np.random.default_rng(seed)
    gates = rng.normal(0, 1 / np.sqrt(features + hidden), (features + hidden + 1, 4 * hidden))
    gates[-1] = 0
    gates[-1, hidden : 2 * hidden] = 1.0  # memory is kept at first
    return {"gates": gates, "look": rng.normal(0, 1 / np.sqrt(hidden), (hidden, attention)), "ask": rng.normal(0, 1 / np.sqrt(attention), attention),
            "out": rng.normal(0, 1 / np.sqrt(hidden), hidden), "bias": np.zeros(1)}


def sequence_forward(w: Weights, x: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Score of each sequence of ``x`` (row, step, feature): states of all steps, weighted by what attention makes of them."""
    n, steps, features = x.shape
    size = len(w["out"])
    # What the inputs add to the gates is one product for all steps; rows of a step lie together.
    given = np.ascontiguousarray(x.transpose(1, 0, 2))
    z = (given.reshape(-1, features) @ w["gates"][:features] + w["gates"][-1]).reshape(steps, n, 4 * size)
    h, c = np.zeros((steps + 1, n, size)), np.zeros((steps + 1, n, size))
    gates, squashed = np.empty((steps, n, 4 * size)), np.empty((steps, n, size))
    for t in range(steps):
        now = z[t] + h[t] @ w["gates"][features:-1]
        now[:, : 3 * size] *= 0.5
        np.tanh(now, out=gates[t])
        gates[t, :, : 3 * size] += 1
        gates[t, :, : 3 * size] *= 0.5  # a sigmoid
        i, f, o, g = (gates[t, :, k * size : (k + 1) * size] for k in range(4))
        np.add(f * c[t], i * g, out=c[t + 1])
        np.tanh(c[t + 1], out=squashed[t])
        np.multiply(o, squashed[t], out=h[t + 1])
    states = np.ascontiguousarray(h[1:].transpose(1, 0, 2))
    looked = np.tanh(states @ w["look"])
    e = looked @ w["ask"]
    alpha = np.exp(e - e.max(1, keepdims=True))
    alpha /= alpha.sum(1, keepdims=True)
    pooled = (alpha[:, :, None] * states).sum(1)
    return pooled @ w["out"] + w["bias"][0], ((given, gates, squashed, h, c), states, looked, alpha, pooled)


def sequence_gradient(w: Weights, x: np.ndarray, y: np.ndarray, row_weight: np.ndarray) -> tuple[float, float, Weights]:
    """Weighted log loss and its gradients, back through attention and time; ``ROWS`` sequences at a time, so that they stay in the cache."""
    value, total = 0.0, {k: np.zeros_like(v) for k, v in w.items()}
    for at in range(0, len(x), ROWS):
        some = slice(at, at + ROWS)
        one, grads = _sequence_gradient(w, x[some], y[some], row_weight[some])
        value += one
        for k, v in grads.items():
            total[k] += v
    return value, float(row_weight.sum()), total


def _sequence_gradient(w: Weights, x: np.ndarray, y: np.ndarray, row_weight: np.ndarray) -> tuple[float, Weights]:
    score, ((given, gates, squashed, h, c), states, looked, alpha, pooled) = sequence_forward(w, x)
    value = float((row_weight * (np.logaddexp(0, score) - y * score)).sum())
    d = row_weight * (_sigmoid(score) - y)
    (n, steps, features), size = x.shape, len(w["out"])
    out = {"out": pooled.T @ d, "bias": np.array([d.sum()])}
    d_pooled = d[:, None] * w["out"]
    d_alpha = (states @ d_pooled[:, :, None])[:, :, 0]
    d_e = alpha * (d_alpha - (alpha * d_alpha).sum(1, keepdims=True))
    d_looked = d_e[:, :, None] * w["ask"] * (1 - looked * looked)
    out["ask"] = looked.reshape(-1, looked.shape[2]).T @ d_e.ravel()
    out["look"] = states.reshape(-1, size).T @ d_looked.reshape(-1, looked.shape[2])
    d_states = np.ascontiguousarray((alpha[:, :, None] * d_pooled[:, None, :] + d_looked @ w["look"].T).transpose(1, 0, 2))
    dz, dh_next, dc_next = np.empty_like(gates), 0.0, 0.0
    back = np.ascontiguousarray(w["gates"][features:-1].T)
    for t in range(steps - 1, -1, -1):
        i, f, o, g = (gates[t, :, k * size : (k + 1) * size] for k in range(4))
        di, df, do, dg = (dz[t, :, k * size : (k + 1) * size] for k in range(4))
        dh = d_states[t] + dh_next
        th = squashed[t]
        dc = dh * o * (1 - th * th) + dc_next
        np.multiply(dc * g, i * (1 - i), out=di)
        np.multiply(dc * c[t], f * (1 - f), out=df)
        np.multiply(dh * th, o * (1 - o), out=do)
        np.multiply(dc * i, 1 - g * g, out=dg)
        dh_next, dc_next = dz[t] @ back, dc * f
    flat = dz.reshape(-1, 4 * size)
    out["gates"] = np.concatenate([given.reshape(-1, features).T @ flat, h[:-1].reshape(-1, size).T @ flat, flat.sum(0)[None]])
    return value, out


def _sequences(batch: pa.RecordBatch, name: str, length: int) -> np.ndarray:
    values = batch.column(name).flatten().flatten().to_numpy(zero_copy_only=False).astype(float)
    return np.nan_to_num(values.reshape(len(batch), length, -1))


def fit_sequences(df: DataFrame, sequence: str, label: str, length: int, features: int, hidden: int = 16, steps: int = 60, rate: float = 0.02, share: int = 1,
                  unique: str | None = None, seed: int = 42) -> tuple[Weights, list[float]]:
    """Weights of the sequence model and its losses; classes weigh alike. Every sequence must have ``length`` steps; NULLs count as 0."""
    classes = {r[0]: r[1] for r in df.groupBy(F.col(label).cast("int")).count().collect()}
    total = sum(classes.values())
    weigh = F.lit(1.0)
    for y, n in classes.items():
        weigh = F.when(F.col(label) == y, total / (len(classes) * n)).otherwise(weigh)
    rows = df.select(sequence, F.col(label).cast("double").alias("y"), weigh.alias("w"), *([unique] if unique else []))

    def loss(w: Weights, batch: pa.RecordBatch) -> tuple[float, float, Weights]:
        return sequence_gradient(w, _sequences(batch, sequence, length), _column(batch, "y"), _column(batch, "w"))

    return descend(rows, sequence_weights(features, hidden, seed=seed), loss, steps, rate, share, unique)


def score_sequences(df: DataFrame, weights: Weights, sequence: str, length: int, name: str = "probability") -> DataFrame:
    """The rows without their sequence, with the model's probability and ``attention``, the weight of each step."""
    shared = df.sparkSession.sparkContext.broadcast(weights)
    rest = [f for f in df.schema.fields if f.name not in (sequence, name, "attention")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, (*_, alpha, _) = sequence_forward(shared.value, _sequences(batch, sequence, length))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), pa.array(_sigmoid(score)), pa.array(list(alpha), pa.list_(pa.float64()))], names=[*(f.name for f in rest), name, "attention"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rest)
    return df.mapInArrow(work, f"{schema}{name} double, attention array<double>")


# ---- groups: bottleneck networks


LAYERS = ("into", "narrow", "widen", "back")


def group_weights(groups: int, features: int, wide: int = 8, narrow: int = 4, seed: int = 42) -> Weights:
    """One network for each group: features - wide - narrow - wide - features; all groups start alike."""
    rng, sizes = np.random.default_rng(seed), [features, wide, narrow, wide, features]
    out = {}
    for name, a, b in zip(LAYERS, sizes[:-1], sizes[1:], strict=True):
        layer = rng.normal(0, 1 / np.sqrt(a), (a + 1, b))
        layer[-1] = 0
        out[name] = np.repeat(layer[None], groups, 0)
    return out


def group_forward(w: Weights, x: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """What each row's own network gives back for it, and the inputs of its layers."""
    inputs, now = [], x
    for k, name in enumerate(LAYERS):
        now = np.concatenate([now, np.ones((len(x), 1))], 1)
        inputs.append(now)
        out = np.zeros((len(x), w[name].shape[2]))
        for g in np.unique(group):
            mine = group == g
            out[mine] = now[mine] @ w[name][g]
        now = np.tanh(out) if k < len(LAYERS) - 1 else out
    return now, inputs


def group_gradient(w: Weights, x: np.ndarray, group: np.ndarray) -> tuple[float, float, Weights]:
    """Sum of mean squared errors, and gradients in the slots of the rows' groups."""
    got, inputs = group_forward(w, x, group)
    d = 2 * (got - x) / x.shape[1]
    out = {name: np.zeros_like(w[name]) for name in LAYERS}
    for k in range(len(LAYERS) - 1, -1, -1):
        name, below = LAYERS[k], np.zeros((len(x), inputs[k].shape[1]))
        for g in np.unique(group):
            mine = group == g
            out[name][g] = inputs[k][mine].T @ d[mine]
            below[mine] = d[mine] @ w[name][g].T
        if k:
            d = below[:, :-1] * (1 - inputs[k][:, :-1] ** 2)
    return float((((got - x) ** 2).mean(1)).sum()), float(len(x)), out


def fit_groups(df: DataFrame, cols: list[str], by: str, steps: int = 80, rate: float = 0.02, share: int = 1, unique: str | None = None, seed: int = 42) -> dict:
    """Networks of all groups of ``by``, from scaled features (ranges of each group; NULLs count as the group's mean).

    Groups are known by name; their number is bounded by the model, which the driver holds.
    """
    stats = [F.struct(F.min(c).alias("lo"), F.max(c).alias("hi"), F.avg(c).alias("mean")).alias(c) for c in cols]
    ranges = df.where(F.col(by).isNotNull()).groupBy(by).agg(*stats).orderBy(by).collect()
    model = {"names": [r[by] for r in ranges], "cols": cols}
    for k, what in enumerate(("lo", "hi", "mean")):
        model[what] = np.array([[float(r[c][k]) if r[c][k] is not None else 0.0 for c in cols] for r in ranges]).reshape(len(ranges), len(cols))
    model["weights"] = group_weights(len(ranges), len(cols), seed=seed)

    def loss(w: Weights, batch: pa.RecordBatch) -> tuple[float, float, Weights]:
        x, group = _scaled(batch, model, by)
        return group_gradient(w, x[group >= 0], group[group >= 0])

    rows = df.select(by, *[F.col(c).cast("double").alias(c) for c in cols], *([unique] if unique and unique not in cols else []))
    if ranges:
        model["weights"], model["losses"] = descend(rows, model["weights"], loss, steps, rate, share, unique)
    return model


def _scaled(batch: pa.RecordBatch, model: dict, by: str) -> tuple[np.ndarray, np.ndarray]:
    number = {name: k for k, name in enumerate(model["names"])}
    group = np.array([number.get(v, -1) for v in batch.column(by).to_pylist()], np.int64)
    x = np.stack([_column(batch, c) for c in model["cols"]], 1) if len(batch) else np.zeros((0, len(model["cols"])))
    x = np.where(np.isnan(x), model["mean"][group] if len(model["names"]) else 0.0, x)
    span = np.where(model["hi"] > model["lo"], model["hi"] - model["lo"], 1.0)
    return ((x - model["lo"][group]) / span[group] if len(model["names"]) else x), group


def group_errors(df: DataFrame, model: dict, by: str) -> DataFrame:
    """The rows with ``fitted_error``, the mean squared error of what their group's network gives back, and ``err_*`` for each feature.
    Groups that the model does not know have NULL errors."""
    plain = {k: v for k, v in model.items() if k != "losses"}
    shared, cols = df.sparkSession.sparkContext.broadcast(plain), model["cols"]
    fields = df.schema.fields
    typed = df.withColumns({f"__{c}": F.col(c).cast("double") for c in cols})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            inner = pa.RecordBatch.from_arrays([batch.column(by), *(batch.column(f"__{c}") for c in cols)], names=[by, *cols])
            x, group = _scaled(inner, m, by)
            errors = np.full(x.shape, np.nan)
            known = group >= 0
            errors[known] = (group_forward(m["weights"], x[known], group[known])[0] - x[known]) ** 2
            mean = errors.mean(1) if len(cols) else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), pa.array(mean, from_pandas=True), *(pa.array(errors[:, k], from_pandas=True) for k in range(len(cols)))],
                                             names=[*(f.name for f in fields), "fitted_error", *(f"err_{c}" for c in cols)])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields) + "fitted_error double, " + ", ".join(f"err_{c} double" for c in cols)
    return typed.mapInArrow(work, schema)
