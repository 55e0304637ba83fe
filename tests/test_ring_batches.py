"""Rings found batch by batch: together those of the whole digraph, from what the store keeps and no more."""

import os
import random

from pyspark.sql import functions as F

from tracewell.operators import graph as G
from tracewell.streaming import rings

PAID = "src string, dst string, amount double, first_us long, at long, turn long"


def _batches(n=10, per=9):
    """Payments among 14 accounts; running totals and first times by pair, as the account state has them."""
    rng, totals, at, out = random.Random(3), {}, 0, []
    for _ in range(n):
        rows = []
        for _ in range(per):
            a, b = rng.sample(range(14), 2)
            at += 1_000_000
            amount, first = totals.get((a, b), (0.0, at))
            totals[a, b] = (amount + 10.0, first)
            rows.append((f"ACC_{a:02d}", f"ACC_{b:02d}", *totals[a, b], at, at))
        out.append(rows)
    return out, totals


def _bytes(folders):
    return sum(os.path.getsize(os.path.join(d, f)) for folder in folders for d, _, files in os.walk(folder) for f in files if f.endswith(".parquet"))


def test_rings_of_all_batches_are_those_of_the_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rings, "BUCKETS", 4)
    monkeypatch.setattr(rings, "COMPACT", 3)
    batches, totals = _batches()
    path, store, found, sizes = str(tmp_path / "s"), None, [], []
    for k, rows in enumerate(batches):
        if k in (0, 5):
            store = rings.Store(spark, path)  # a restart reads what counts from the store's list
        for _ in range(2 if k == 4 else 1):  # a batch that runs again
            store.begin(k)
            paid = spark.createDataFrame(rows, PAID).select("src", "dst", "amount", F.timestamp_micros("first_us").alias("first_ts"), F.col("at").alias("seen"), "turn")
            got = rings.update(store, paid, k).collect()
            store.end(k)
        found.append({tuple(r.path): r for r in got})
        assert all(len(v) <= 4 for name, v in store.kept.items() if name != "rings")
        sizes.append(_bytes(store.kept["totals"]))
    paths = [p for f in found for p in f]
    digraph = spark.createDataFrame([(f"ACC_{a:02d}", f"ACC_{b:02d}", v[0]) for (a, b), v in totals.items()], "src string, dst string, amount double")
    whole = {tuple(r.path) for r in G.find_cycles(digraph).collect()}
    assert len(paths) == len(set(paths)) and set(paths) == whole and len(whole) > 30
    # A ring closes with its last edge, and shows the amounts as they are then.
    for k, f in enumerate(found):
        until = batches[k][-1][4]
        for p, r in f.items():
            hops = [(int(a[4:]), int(b[4:])) for a, b in zip(p, p[1:] + p[:1])]
            assert int(r.closed_at.timestamp() * 1e6) == max(totals[h][1] for h in hops) <= until
    # What a batch may read stays near what there is to know: merged totals, one row for each pair.
    assert sizes[-1] < 3 * max(sizes[2:5])


def test_only_buckets_of_the_accounts_at_hand_are_read(spark, tmp_path):
    store = rings.Store(spark, str(tmp_path / "s"))
    pairs = spark.range(400).select(F.concat(F.lit("A"), "id").alias("src"), F.concat(F.lit("B"), "id").alias("dst"))
    store.write("out", pairs, 0, "src")
    near = spark.createDataFrame([("A7",)], "m string")
    some, every = store.read("out", rings.PAIR, near, "m"), store.read("out", rings.PAIR)
    assert every.count() == 400 and len(some.inputFiles()) >= 1
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert 1 <= some.count() < 60 and some.where("src = 'A7'").count() == 1
    assert store.read("none", rings.PAIR).count() == 0
