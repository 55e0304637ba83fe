"""Per-account memory: pairs against plain Python, and bounded state."""

import random

import pytest
from pyspark.sql import functions as F

from tracewell.sources import readers
from tracewell.streaming import retention, runs

HOUR = 3_600_000_000
BASE = 1_700_000_000_000_000
SCHEMA = "account_id string, kind string, id string, us long"


def _plain(batches, window, keep):
    """Events one by one as they arrive."""
    memory, newest, out = {}, {}, []
    for batch in batches:
        for account, kind, id_, us in sorted(batch, key=lambda e: (e[3], e[1], e[2])):
            if account is None:
                continue
            other = [k for k in retention.KINDS if k != kind][0]
            for i, t in memory.get((account, other), []):
                if abs(t - us) <= window and t >= newest[account, other] - keep:
                    out.append((account, id_, i, abs(t - us) / 1e6, t <= us) if kind == "transaction" else (account, i, id_, abs(t - us) / 1e6, us <= t))
            memory.setdefault((account, kind), []).append((id_, us))
            newest[account, kind] = max(us, newest.get((account, kind), us))
    return sorted(out)


def _stream(spark, run, batches):
    for k, rows in enumerate(batches):
        df = spark.createDataFrame(rows, SCHEMA).select("account_id", "kind", "id", F.timestamp_micros("us").alias("timestamp"))
        df.coalesce(1).write.parquet(f"{run}/in/p={k:02d}")
    return readers.read_event_stream(spark, f"{run}/in/p=*", df.schema, "parquet", max_files=1)


def _events(seed=1):
    """A busy account with half of the events, quiet ones with long gaps, and events that come one or two batches late."""
    rng = random.Random(seed)
    batches = [[] for _ in range(7)]
    for n in range(400):
        account = "busy" if n % 2 else rng.choice(["a", "b", "quiet", None])
        day = rng.randrange(5) if account != "quiet" else rng.choice([0, 4])
        us = BASE + day * 24 * HOUR + rng.randrange(24 * HOUR // 10**6 // 60) * 60 * 10**6
        batches[day + rng.choice([0, 0, 0, 1, 2])].append((account, rng.choice(retention.KINDS), f"e{n}", us))
    return batches


@pytest.mark.parametrize("spread", [1, 3])
def test_pairs_are_those_of_events_one_by_one(spark, spread):
    batches = _events()
    want = _plain(batches, 2 * HOUR, 24 * HOUR)
    run = runs.new_run(spark)
    got = runs.drain(retention.remembered_pairs(_stream(spark, run, batches), 7200.0, 86400.0, "400 days", spread), run)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100
    everything = _plain([sum(batches, [])], 2 * HOUR, 24 * HOUR)
    assert len(_plain(batches, 2 * HOUR, 10**18)) == len(everything) > len(want)  # forgetting makes a difference


def test_a_quiet_account_remembers_and_a_late_event_is_judged_by_its_account(spark):
    day = 24 * HOUR
    batches = [[("q", "access", "q1", BASE), ("b", "access", "b1", BASE)], [("b", "access", "b2", BASE + 3 * day)],
               [("q", "transaction", "q2", BASE + 60 * 10**6), ("b", "transaction", "b3", BASE + 60 * 10**6)]]
    run = runs.new_run(spark)
    got = runs.drain(retention.remembered_pairs(_stream(spark, run, batches), 240.0, 86400.0, "30 days"), run)
    assert [tuple(r) for r in got.collect()] == [("q", "q2", "q1", 60.0, True)]


def test_state_does_not_grow_with_the_stream(spark):
    """Ten days of one busy account, an event a minute; quiet ones that never come back are cleared by their timers."""
    batches = []
    for day in range(10):
        rows = [("busy", retention.KINDS[m % 2], f"d{day}m{m}", BASE + day * 24 * HOUR + m * 6 * 60 * 10**6) for m in range(240)]
        batches.append(rows + [(f"once{day}", "access", f"o{day}", BASE + day * 24 * HOUR)])
    run = runs.new_run(spark)
    stream = retention.remembered_pairs(_stream(spark, run, batches), 240.0, 3600.0, "2 hours")
    query = stream.writeStream.format("noop").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{run}/c").start()
    query.awaitTermination()
    assert query.exception() is None
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert len(sizes) >= 10 and max(sizes[-3:]) <= max(sizes[1:4]) + 15


def test_accounts_of_one_group_keep_apart(spark, monkeypatch):
    """All accounts under one key: pairs are of one account only, also where events of two have the same time, and a group is called
    once for a batch however many accounts it has."""
    monkeypatch.setattr(retention, "GROUPS", 1)
    calls = spark.sparkContext.accumulator(0)

    class Counted(retention.AccountMemory):
        def handleInputRows(self, key, rows, timerValues):
            calls.add(1)
            yield from super().handleInputRows(key, rows, timerValues)

    monkeypatch.setattr(retention, "AccountMemory", Counted)
    accounts = [f"a{k}" for k in range(30)]
    batches = [[(a, "access", f"x{a}", BASE) for a in accounts], [(a, "transaction", f"y{a}", BASE + 60 * 10**6) for a in accounts]]
    run = runs.new_run(spark)
    got = runs.drain(retention.remembered_pairs(_stream(spark, run, batches), 240.0, 86400.0, "30 days"), run)
    assert sorted(tuple(r) for r in got.collect()) == sorted((a, f"y{a}", f"x{a}", 60.0, True) for a in accounts)
    assert 2 <= calls.value <= 4
