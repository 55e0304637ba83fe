"""Streams give what the batch operators give."""

import pytest
from build import access, txns
from conftest import SF
from pyspark.sql import functions as F

from tracewell import schemas
from tracewell.operators import detect, links, structuring
from tracewell.sources import readers, views
from tracewell.streaming import detectors, runs


def events(spark, **options):
    return readers.read_event_stream(spark, SF, schemas.EVENTS, "parquet", glob="events.parquet", **options)


def ids(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()))


def test_link_stream(spark, tables):
    out = runs.drain(detectors.stream_link(views.project_access(events(spark)), views.project_transactions(events(spark))), runs.new_run(spark))
    assert ids(out, "transaction_id", "access_id") == ids(links.temporal_link(*tables[:2]), "transaction_id", "access_id")


@pytest.mark.parametrize("chunks", [1, 3])
def test_replayed_alerts(spark, tables, chunks):
    a, t, _ = tables
    run = runs.new_run(spark)
    out = detectors.stream_alerts(a, t, run, chunks, 43200)
    cols = ["alert_id", "severity", "composite_risk_score"]
    assert ids(out, *cols) == ids(detect.alerts(a, t, burst_window_s=43200), *cols)
    assert out.select("batch").distinct().count() == chunks


def test_burst_stream_over_several_batches(spark, tables):
    _, t, _ = tables
    run = runs.new_run(spark)
    for i, part in enumerate(("timestamp < '2024-01-12'", "timestamp >= '2024-01-12'")):
        t.where(part).coalesce(1).write.parquet(f"{run}/in/p={i}")
    stream = readers.read_event_stream(spark, f"{run}/in/p=*", t.schema, "parquet", max_files=1)
    out = runs.drain(detectors.stream_bursts(stream, window_s=43200), run)
    cols = ["transaction_id", "cluster_count", "aggregate_amount", "rule_matched"]
    assert ids(out, *cols) == ids(structuring.burst_rule(t, 43200), *cols)


def test_late_and_shuffled_rows_get_the_batch_answer(spark):
    """Rows within the watermark's delay, dealt to five batches in no order: each sees what arrived by then, and one that comes
    last sees all."""
    t = txns(spark, *[{"timestamp": f"2026-01-01 00:{m:02d}:00", "transaction_id": f"T{m:02d}", "amount": 20000.0} for m in range(0, 50, 2)])
    run = runs.new_run(spark)
    late = "transaction_id = 'T30'"
    for i in range(4):
        t.where(f"not {late} and crc32(transaction_id) % 4 = {i}").coalesce(1).write.parquet(f"{run}/in/p={i}")
    t.where(late).coalesce(1).write.parquet(f"{run}/in/p=9")
    stream = readers.read_event_stream(spark, f"{run}/in/p=*", t.schema, "parquet", max_files=1)
    got = {r.transaction_id: (r.cluster_count, r.rule_matched) for r in runs.drain(detectors.stream_bursts(stream, window_s=3600, keep=5), run).collect()}
    want = {r.transaction_id: (r.cluster_count, r.rule_matched) for r in structuring.burst_rule(t, 3600, n=5).collect()}
    assert len(got) == len(want) == 25 and got["T30"] == want["T30"] and got["T30"][0] == 5


def test_counters_over_many_batches(spark, tables):
    t = tables[1]
    run = runs.new_run(spark)
    for i in range(4):
        t.where(F.pmod(F.crc32("transaction_id"), F.lit(4)) == i).coalesce(1).write.parquet(f"{run}/in/p={i}")
    stream = readers.read_event_stream(spark, f"{run}/in/p=*", t.schema, "parquet", max_files=1)
    runs.drain_batches(detectors.stream_nodes(stream), run, detectors.table_sink(f"{run}/nodes"), mode="update")
    got = detectors.newest(spark, f"{run}/nodes", ["account_id"])
    assert got.count() == t.select("account_id").distinct().count() and got.agg(F.sum("txn_count")).head()[0] == t.count()


def test_repeated_transactions_are_dropped(spark):
    t = txns(spark, {"timestamp": "2026-01-01 00:00:00"}, {"timestamp": "2026-01-01 00:00:01"})
    run = runs.new_run(spark)
    t.unionByName(t).write.parquet(f"{run}/in")
    stream = readers.read_event_stream(spark, f"{run}/in", t.schema, "parquet")
    assert runs.drain(detectors.unique_transfers(stream), run).count() == 2


def test_rows_behind_the_watermark_are_dropped_and_counted(spark):
    run = runs.new_run(spark)
    a = access(spark, {"timestamp": "2026-01-01 00:00:00"}, {"timestamp": "2026-01-05 00:00:00"})
    a.where("event_id = 0").write.parquet(f"{run}/a")
    for i, ts in enumerate(("2026-01-09 00:00:00", "2026-01-09 00:01:00", "2026-01-01 00:01:00")):
        txns(spark, {"timestamp": ts, "transaction_id": f"T{i}"}).coalesce(1).write.parquet(f"{run}/t/p={i}")
    astream = readers.read_event_stream(spark, f"{run}/a", a.schema, "parquet").withWatermark("timestamp", "1 hour")
    tstream = readers.read_event_stream(spark, f"{run}/t/p=*", txns(spark, {"timestamp": "2026-01-01 00:00:00"}).schema, "parquet", max_files=1)
    counts = tstream.withWatermark("timestamp", "1 hour").groupBy(F.window("timestamp", "1 hour")).count()
    query = counts.writeStream.format("noop").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{run}/c").start()
    query.awaitTermination()
    assert runs.late_rows(query) == 1 and astream.isStreaming


def test_accounts_of_one_key_do_not_see_each_other(spark, monkeypatch):
    """All accounts in one key, three batches, a NULL account and NULL amounts: each row sees its own account's window only; the key is
    called once for a batch, not once for each account."""
    monkeypatch.setattr(detectors, "PARTS", 1)
    rows = [{"account_id": None if a == 3 else f"A{a}", "timestamp": f"2026-01-01 00:{m:02d}:{a:02d}", "transaction_id": f"T{a:02d}{m:02d}", "amount": None if (a + m) % 5 == 0 else 20000.0 + a + 0.01 * m}
            for a in range(12) for m in range(0, 50, 3)]
    t = txns(spark, *rows)
    run = runs.new_run(spark)
    for i in range(3):
        t.where(f"minute(timestamp) % 3 = 0 and floor(minute(timestamp) / 17) = {i}").coalesce(1).write.parquet(f"{run}/in/p={i}")
    stream = readers.read_event_stream(spark, f"{run}/in/p=*", t.schema, "parquet", max_files=1)
    out = runs.drain(detectors.stream_bursts(stream, window_s=900, keep=4), run)
    cols = ["transaction_id", "cluster_count", "aggregate_amount", "rule_matched"]
    assert ids(out, *cols) == ids(structuring.burst_rule(t, 900, n=4), *cols)
    assert out.select("transaction_id").count() == len(rows)


def test_sums_of_stretches_stand_alone():
    import numpy as np

    values = np.array([1e16, 1.0, 2.0, 3.0])
    assert detectors._sums(values, np.array([1, 1, 3, 0]), np.array([2, 4, 4, 1])).tolist() == [1.0, 6.0, 3.0, 1e16]
