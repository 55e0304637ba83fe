"""Exact Shapley values of tree ensembles.

The value of a set of known features is the expected score when a tree is walked down with them: at a split on an unknown feature
both sides are taken, weighted by the training rows that went there (cover). The Shapley value of a feature averages what it
adds over all orders in which features become known.

Each leaf is a game of its own among the features on its path. For a leaf, feature j is a pair: ``open``, whether the row meets all
of the path's conditions on j, and ``share``, the part of the cover that does when j is unknown. The sums over all subsets of
the other features, weighted by subset size, are coefficients of a polynomial: the path is extended feature by feature, and one
feature is unwound at a time, which is of order depth^2 for a leaf. As ``open`` is a bit for each feature, a leaf has at most
2^features results, which are worked out once for a batch of rows and looked up for each of its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Tree = dict[str, np.ndarray]  # feature (-1 in leaves), cut, left, right, value, cover; the root comes first


def stored_trees(spark: SparkSession, path: str) -> list[tuple[float, Tree]]:
    """(weight, tree) of a saved ensemble, read from its node table: as large as the model. ``path``: the ensemble's own folder."""
    nodes = spark.read.parquet(f"{path}/data").toDF("treeID", "nodeData")
    flat = nodes.select("treeID", F.col("nodeData.id").alias("id"), F.col("nodeData.prediction").alias("value"), F.col("nodeData.leftChild").alias("left"),
                        F.col("nodeData.rightChild").alias("right"), F.col("nodeData.split.featureIndex").alias("feature"),
                        F.col("nodeData.split.numCategories").alias("categories"), F.get("nodeData.split.leftCategoriesOrThreshold", 0).alias("cut"),
                        F.get("nodeData.impurityStats", 0).alias("cover"))
    weights = dict(spark.read.parquet(f"{path}/treesMetadata").toDF("treeID", "metadata", "weights").select("treeID", "weights").toPandas().itertuples(index=False))
    out = []
    for tree, rows in flat.toPandas().groupby("treeID"):
        rows = rows.sort_values("id")
        if (rows["categories"][rows["left"] >= 0] >= 0).any():
            raise ValueError("splits on categories are not supported")
        inner = rows["left"].to_numpy() >= 0
        out.append((float(weights[tree]), {
            "feature": np.where(inner, rows["feature"], -1).astype(np.int64), "cut": np.where(inner, rows["cut"], 0.0).astype(float),
            "left": rows["left"].to_numpy(np.int64), "right": rows["right"].to_numpy(np.int64), "value": rows["value"].to_numpy(float), "cover": rows["cover"].to_numpy(float)}))
    return out


def leaves(tree: Tree) -> Iterator[tuple[float, dict[int, list[float]]]]:
    """(value, {feature: [lower bound, upper bound, share]}) of every leaf; a row is open if lower < x <= upper."""
    todo: list[tuple[int, dict[int, list[float]]]] = [(0, {})]
    while todo:
        node, path = todo.pop()
        f = int(tree["feature"][node])
        if f < 0:
            yield float(tree["value"][node]), path
            continue
        for child, side in ((int(tree["left"][node]), 1), (int(tree["right"][node]), 0)):
            low, high, share = path.get(f, [-np.inf, np.inf, 1.0])
            share *= tree["cover"][child] / tree["cover"][node]
            cut = float(tree["cut"][node])
            bounds = [low, min(high, cut), share] if side else [max(low, cut), high, share]
            todo.append((child, {**path, f: bounds}))


def compiled(trees: list[tuple[float, Tree]]) -> tuple[float, list[tuple[np.ndarray, ...]]]:
    """(expected score, [(features, lower, upper, share, value)]), one entry for all leaves of a tree with equally many features."""
    base, groups = 0.0, []
    for weight, tree in trees:
        by_size: dict[int, list] = {}
        for value, path in leaves(tree):
            base += weight * value * float(np.prod([p[2] for p in path.values()]))
            if path:
                by_size.setdefault(len(path), []).append((list(path), [p[0] for p in path.values()], [p[1] for p in path.values()], [p[2] for p in path.values()], weight * value))
        for rows in by_size.values():
            f, low, high, share, value = zip(*rows, strict=True)
            groups.append((np.array(f), np.array(low), np.array(high), np.array(share), np.array(value)))
    return base, groups


def contributions(share: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Shapley values (leaf, pattern, feature) of leaves with ``share`` (leaf, feature); bit j of a pattern: feature j is open."""
    n, d = share.shape
    patterns = np.arange(1 << d)
    open_ = [((patterns >> j) & 1).astype(float)[None, :] for j in range(d)]
    # Entry k: weighted sum over the subsets with k open features of the products of their bits and the others' shares.
    path = [np.ones((n, len(patterns)))]
    for j in range(d):
        m, z = j + 2, share[:, j : j + 1]
        grown = [np.zeros_like(path[0]) for _ in range(m)]
        for k in range(m - 1):
            grown[k + 1] += open_[j] * path[k] * ((k + 1) / m)
            grown[k] += z * path[k] * ((m - 1 - k) / m)
        path = grown
    out = np.empty((n, len(patterns), d))
    for j in range(d):
        z, is_open = share[:, j : j + 1], open_[j] > 0
        rest, with_, without = path[d], np.zeros_like(path[0]), np.zeros_like(path[0])
        for k in range(d - 1, -1, -1):
            step = rest * ((d + 1) / (k + 1))
            with_ += step
            rest = path[k] - step * z * ((d - k) / (d + 1))
            without += path[k] * ((d + 1) / (d - k))
        out[:, :, j] = np.where(is_open, with_ * (1.0 - z), -without) * value[:, None]
    return out


def shapley(x: np.ndarray, groups: list[tuple[np.ndarray, ...]]) -> np.ndarray:
    """Shapley values (row, feature) of all trees together; a missing value goes right, as it does in the trees."""
    out = np.zeros_like(x)
    for f, low, high, share, value in groups:
        table = contributions(share, value)
        for k in range(len(f)):
            column = x[:, f[k]]
            open_ = ~(column <= low[k]) & ((column <= high[k]) | (high[k] == np.inf))
            out[:, f[k]] += table[k][open_ @ (1 << np.arange(f.shape[1]))]
    return out


def attribute(df: DataFrame, trees: list[tuple[float, Tree]], cols: list[str]) -> DataFrame:
    """``base_value`` and ``attributions``, one Shapley value for each of ``cols``: together they are the raw score.

    The leaves are broadcast; their number is that of the model's, whatever the rows.
    """
    shared = df.sparkSession.sparkContext.broadcast(compiled(trees))
    typed = df.withColumns({c: F.col(c).cast("double") for c in cols})
    schema = T.StructType([*typed.schema.fields, T.StructField("base_value", T.DoubleType()), T.StructField("attributions", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, groups = shared.value
        for batch in batches:
            values = shapley(batch[cols].to_numpy(dtype=float), groups)
            yield batch.assign(base_value=base, attributions=list(values))

    return typed.mapInPandas(run, schema)


def saved_ensemble(spark: SparkSession, model: PipelineModel, path: str) -> list[tuple[float, Tree]]:
    """The trees of a saved pipeline whose last stage is an ensemble; ``path``: the pipeline's folder."""
    last = model.stages[-1]
    return stored_trees(spark, f"{path}/stages/{len(model.stages) - 1}_{last.uid}")
