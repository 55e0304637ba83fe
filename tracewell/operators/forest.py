"""Isolation forest: each tree grown in a task of its own from its own sample of all rows, rows scored where they lie."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.operators.stats import quantiles


def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def grow(points: np.ndarray, rng: np.random.Generator) -> list[tuple[int, float, int, int, float]]:
    """Random splits down to log2(n) levels, as (feature, cut, left, right, depth) rows; feature -1 is a leaf."""
    top = math.ceil(math.log2(max(2, len(points))))
    rows: list = []
    todo = [(points, 0, None, 0)]
    while todo:
        pts, depth, parent, side = todo.pop()
        at = len(rows)
        if parent is not None:
            rows[parent][side] = at
        lo, hi = (pts.min(axis=0), pts.max(axis=0)) if len(pts) else (None, None)
        open_dims = np.flatnonzero(hi > lo) if len(pts) > 1 else np.empty(0, dtype=int)
        if depth >= top or not len(open_dims):
            rows.append([-1, 0.0, -1, -1, depth + average_path(len(pts))])
            continue
        dim = int(rng.choice(open_dims))
        cut = float(rng.uniform(lo[dim], hi[dim]))
        rows.append([dim, cut, -1, -1, 0.0])
        mask = pts[:, dim] < cut
        todo += [(pts[mask], depth + 1, at, 2), (pts[~mask], depth + 1, at, 3)]
    return [tuple(r) for r in rows]


class IsolationForest:
    """100 trees over 256 rows each; ``score`` adds the raw anomaly score (positive = anomalous)."""

    def __init__(self, cols: list[str], trees: int = 100, sample: int = 256, contamination: float = 0.05, seed: int = 42):
        self.cols, self.trees, self.sample = cols, trees, sample
        self.contamination, self.seed = contamination, seed
        self.nodes: pd.DataFrame | None = None
        self.offset = 0.0
        self.size = 0

    def drawn(self, typed: DataFrame, n: int) -> DataFrame:
        """Candidates for every tree's sample: rows of ``typed`` (features and _id) whose hash of (row, tree) is low.

        A tree takes those with the smallest hashes; twice as many as it takes are expected here, and only they are sorted.
        """
        limit = 2.0**63 * min(1.0, (2 * self.sample + 64) / max(n, 1))
        hashes = F.transform(F.sequence(F.lit(0), F.lit(self.trees - 1)), lambda t: F.struct(t.alias("tree"), F.xxhash64("_id", t).bitwiseAND(F.lit(2**63 - 1)).alias("_h")))
        return typed.withColumn("_t", F.explode(F.filter(hashes, lambda x: x["_h"] <= limit))).select(*self.cols, "_id", "_t.tree", "_t._h")

    def fit(self, df: DataFrame, row_id: list[str | Column]) -> IsolationForest:
        """``df`` has the feature columns; ``row_id`` tells rows apart, so that equal rows are drawn independently."""
        typed = df.select(*[F.col(c).cast("double").alias(c) for c in self.cols], F.xxhash64(F.lit(self.seed), *row_id).alias("_id")).na.drop()
        n = typed.count()
        self.size = min(self.sample, n)
        cols, seed, size = self.cols, self.seed, self.size

        def build(rows: pd.DataFrame) -> pd.DataFrame:
            tree = int(rows["tree"].iloc[0])
            picked = rows.sort_values(["_h", "_id", *cols]).head(size)[cols].to_numpy(float)
            out = pd.DataFrame(grow(picked, np.random.default_rng([seed, tree])), columns=["feature", "cut", "lo", "hi", "depth"])
            return out.assign(tree=tree, node=range(len(out)))

        schema = "feature int, cut double, lo int, hi int, depth double, tree int, node int"
        # At most trees * 2 * sample rows.
        self.nodes = self.drawn(typed, n).groupBy("tree").applyInPandas(build, schema).toPandas().sort_values(["tree", "node"])
        scored = self._normalised(typed.drop("_id"))
        self.offset = float(quantiles(scored, [], "_s", {"q": 1.0 - self.contamination}).head()[0])
        return self

    def _normalised(self, df: DataFrame) -> DataFrame:
        """Adds ``_s`` = 2 ** (-mean depth / c(sample))."""
        cols, norm = self.cols, average_path(self.size)
        trees = [tuple(t[c].to_numpy() for c in ("feature", "cut", "lo", "hi", "depth")) for _, t in self.nodes.groupby("tree")]
        shared = df.sparkSession.sparkContext.broadcast(trees)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                x = batch[cols].to_numpy(dtype=float)
                total = np.zeros(len(x))
                for feature, cut, lo, hi, depth in shared.value:
                    at = np.zeros(len(x), dtype=int)
                    live = np.flatnonzero(feature[at] >= 0)
                    while len(live):
                        here = at[live]
                        left = x[live, feature[here]] < cut[here]
                        at[live] = np.where(left, lo[here], hi[here])
                        live = live[feature[at[live]] >= 0]
                    total += depth[at]
                yield batch.assign(_s=np.power(2.0, -(total / len(shared.value)) / norm))

        return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField("_s", T.DoubleType())]))

    def score(self, df: DataFrame, name: str = "forest_score") -> DataFrame:
        """Raw score relative to the contamination cut, and the 0/1 prediction."""
        typed = df.withColumns({c: F.col(c).cast("double") for c in self.cols})
        out = self._normalised(typed).withColumn(name, F.col("_s") - F.lit(self.offset)).drop("_s")
        return out.withColumn("is_outlier", (F.col(name) > 0).cast("int"))
