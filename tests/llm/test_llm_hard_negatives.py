import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import hard_negatives as H
from tracewell.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def _rows(n=420, labels=4, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 20)) + rng.normal(size=(labels, 20))[rng.integers(0, labels, n)]
    x[5::9] = x[5]  # copies: many equal scores
    rows = [[k, [float(np.float32(v)) for v in x[k]], int(rng.integers(0, labels)), "own"] for k in range(n)]
    rows[20][1], rows[21][1], rows[22][1][3], rows[23][1][0], rows[24][1][1], rows[25][2], rows[26][0] = None, [], None, float("nan"), float("inf"), None, None
    rows[30][1] = rows[30][1][:7]
    rows[31][1] += [100.0, -3.0]
    return [tuple(r) for r in rows]


def _got(spark, rows, parts=5, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    out = H.mine(df, F.col("vec_id") % 100 == 0, "vec_id", "label", "embedding", scale=256.0, **options)
    return sorted(map(tuple, out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


@pytest.mark.parametrize("options", [{}, {"block_anchors": 2}, {"sample": 1, "ranks": (1,)}, {"sample": 4, "ranks": (1, 2, 3)}])
def test_all_windows_are_those_of_brute_force(spark, options):
    rows = _rows()
    want = brute.hard_negatives([(i, v, y) for i, v, y, _ in rows])
    assert len(want) > 50 and _got(spark, rows, **options) == want


def test_no_rows_one_label_and_repeated_rows(spark):
    rows = _rows()
    assert _got(spark, [r for r in rows if r[0] and r[0] % 100]) == [] and _got(spark, rows[:0] or rows[20:21]) == []
    assert _got(spark, [(*r[:2], 1, "x") for r in rows]) == []
    again = [r for r in rows if r[0] is None or r[0] % 100]
    few = [*rows, *again[:30]]
    assert _got(spark, few) == brute.hard_negatives([(i, v, y) for i, v, y, _ in few])


def test_small_tiles_and_buffers_change_nothing(spark, monkeypatch):
    rows = _rows()
    for name, value in (("TILE_ANCHORS", 2), ("TILE_ROWS", 7), ("BUFFER", 30), ("STRETCH", 3)):
        monkeypatch.setattr(H, name, value)
    assert _got(spark, rows) == brute.hard_negatives([(i, v, y) for i, v, y, _ in rows])


@pytest.mark.parametrize("dims,tau", [(64, 0.3), (64, 0.8), (10, 0.5), (33, -0.1)])
def test_pruned_pairs_are_those_below_the_threshold(dims, tau):
    rng = np.random.default_rng(4)
    a, x = (np.floor(256 * rng.normal(size=(n, dims)) * np.linspace(2, 0.1, dims)) for n in (9, 300))
    limit = tau * np.linalg.norm(a, axis=1) * np.linalg.norm(x, axis=1).mean()
    allowed = rng.random((9, 300)) < 0.8
    got = {(int(i), int(j)): int(s) for who, which, score in H.scored(a, H.suffix_norms(a), limit, x, H.suffix_norms(x), allowed) for i, j, s in zip(who, which, score)}
    exact = a @ x.T
    assert all(got[k] == exact[k] for k in got) and all(allowed[k] for k in got)
    assert {(int(i), int(j)) for i, j in zip(*np.nonzero((exact >= limit[:, None]) & allowed))} <= set(got)


def test_index_leaves_out_covered_dimensions_and_whole_rows():
    x = np.zeros((3, 48))
    x[0, 0], x[1, 20], x[2, 40] = 500, 500, 1
    a = np.ones((1, 48))
    left = H.suffix_norms(x)
    assert [w.tolist() for _, w, _ in H.scored(a, H.suffix_norms(a), np.array([400.0]), x, left, np.ones((1, 3), bool))] != []
    found = [int(r) for _, w, _ in H.scored(a, H.suffix_norms(a), np.array([400.0]), x, left, np.ones((1, 3), bool)) for r in w]
    assert sorted(found) == [0, 1]


def test_large_components_stay_exact_and_too_large_ones_are_refused(spark):
    rng = random.Random(1)
    rows = [(k, [rng.uniform(-1, 1) * 300_000 for _ in range(3)], k % 3, "x") for k in range(300)]
    rows = [(i, [float(np.float32(v)) for v in x], y, s) for i, x, y, s in rows]
    assert _got(spark, rows) == brute.hard_negatives([(i, v, y) for i, v, y, _ in rows])
    with pytest.raises(Exception, match="do not fit"):
        _got(spark, [(i, [v * 1e9 for v in x], y, s) for i, x, y, s in rows])


def test_query_agrees_with_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, list(r.embedding), (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = QUERIES["op13_hard_negatives"](spark, sf).collect()
    assert sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got) == brute.hard_negatives(rows)
