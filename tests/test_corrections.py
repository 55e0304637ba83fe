"""The log of burst results: sums to the batch answer after every batch, takes back what late rows change, counts them."""

from build import txns
from pyspark.sql import functions as F

from tracewell.operators import structuring
from tracewell.streaming import corrections, runs

HOUR = 3600


def _payments(spark):
    """An account with a payment every 20 minutes over two days, and a quiet one."""
    rows = [{"account_id": "busy", "transaction_id": f"T{m:03d}", "timestamp": f"2026-01-0{1 + m // 72} {m // 3 % 24:02d}:{m % 3 * 20:02d}:00", "amount": 20000.0 + m} for m in range(144)]
    return txns(spark, *rows, {"account_id": "quiet", "transaction_id": "Q", "timestamp": "2026-01-01 05:00:00", "amount": 1.0})


def _batches(t):
    """In time order but for every fifth row, which comes two batches late, and every seventh, which is out of order within a batch's reach."""
    m = F.substring("transaction_id", 2, 3).cast("int")
    part = F.when(F.col("account_id") == "quiet", 4).otherwise(F.floor(m / 36) + F.when(m % 5 == 0, 2).when(m % 7 == 0, 1).otherwise(0))
    return [t.where(part == k) for k in range(6)]


def _shown(df):
    return sorted(map(tuple, df.select(*corrections.RESULT).collect()), key=str)


def test_log_sums_to_the_batch_answer_after_every_batch(spark, tmp_path):
    t, store = _payments(spark), str(tmp_path / "s")
    each, seen = corrections.burst_log(spark, store, 2 * HOUR, HOUR), None
    for k, batch in enumerate(_batches(t)):
        each(batch, k)
        if k == 3:
            each(batch, k)  # runs again
        seen = batch if seen is None else seen.unionByName(batch)
        log = corrections.stored(spark, f"{store}/log", corrections.LOG)
        assert _shown(corrections.current(log)) == _shown(structuring.burst_rule(seen, 2 * HOUR)), k
    assert log.where("sign = -1").count() > 20
    per = log.groupBy("transaction_id").agg(F.sum("sign").alias("n")).collect()
    assert all(r.n == 1 for r in per) and len(per) == 145
    # Only results that changed were taken back.
    assert log.where("sign = -1").join(log.where("sign = 1"), [*corrections.RESULT, "batch"]).count() == 0


def test_late_rows_are_counted(spark, tmp_path):
    t, store = _payments(spark), str(tmp_path / "s")
    each = corrections.burst_log(spark, store, 2 * HOUR, HOUR)
    batches = _batches(t)
    for k, batch in enumerate(batches):
        each(batch, k)
    got = {r.batch: (r.n_rows, r.n_late) for r in corrections.counts(spark, store).collect()}
    high = None
    for k, batch in enumerate(batches):
        times = [r[0].timestamp() for r in batch.select("timestamp").collect()]
        assert got[k] == (len(times), sum(1 for x in times if high is not None and x < high - HOUR))
        high = max([*times, *([high] if high is not None else [])])
    assert got[0][1] == 0 and sum(v[1] for v in got.values()) > 10


def test_an_empty_batch_changes_nothing(spark, tmp_path):
    t, store = _payments(spark), str(tmp_path / "s")
    each = corrections.burst_log(spark, store, 2 * HOUR, HOUR)
    each(t.limit(0), 0)
    each(t, 1)
    each(t.limit(0), 2)
    assert _shown(corrections.current(corrections.stored(spark, f"{store}/log", corrections.LOG))) == _shown(structuring.burst_rule(t, 2 * HOUR))


def test_a_slice_is_written_by_many_tasks_and_is_one_batch(spark, tmp_path):
    rows = spark.range(400).select(F.col("id").cast("string").alias("transaction_id"), (F.col("id") % 3).alias("part"))
    slices, seen = [rows.where(F.col("part") == i) for i in (0, 1, 5, 2)], {}  # the third is empty
    runs.replay_slices(slices, str(tmp_path), lambda batch, k: seen.update({k: sorted(r[0] for r in batch.collect())}), "transaction_id")
    assert seen == {k: sorted(r[0] for r in part.collect()) for k, part in enumerate(slices)}
    assert len(list((tmp_path / "in" / "p=0").glob("*.parquet"))) > 1
