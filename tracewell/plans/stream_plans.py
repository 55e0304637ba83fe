"""Streaming queries, each run over what is available and read back from its sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell import schemas
from tracewell.plans.graph_plans import ALL, CYCLES, EDGES, RINGS
from tracewell.plans.history_plans import BURST_S, RULE
from tracewell.plans.link_plans import PAIRS
from tracewell.plans.registry import access, query, txns, us
from tracewell.plans.risk_plans import ALERTS
from tracewell.sources import readers, views
from tracewell.streaming import detectors as S
from tracewell.streaming import corrections, retention, runs


def _events(spark, d):
    return readers.read_event_stream(spark, d, schemas.EVENTS, "parquet", glob="events.parquet")


BATCHES = 4


def _shuffled(spark, d, run, late=True, repeat=False):
    """The transactions as files that a stream takes one by one: in time order, or dealt out by a hash, so that most rows come
    after later ones; ``repeat`` writes every row into two files."""
    rows = txns(spark, d)
    if late:
        part = F.pmod(F.crc32("transaction_id"), F.lit(BATCHES))
    else:
        span = rows.agg(F.struct(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))).scalar()
        part = F.least(F.floor((us("timestamp", "a") - us(span["lo"], "b")) * BATCHES / (us(span["hi"], "c") - us(span["lo"], "d") + 1)), F.lit(BATCHES - 1))
    rows = rows.withColumn("_part", part.cast("int"))
    for i in range(BATCHES):
        mine = (F.col("_part") == i) | ((F.col("_part") + 1) % BATCHES == i) if repeat else F.col("_part") == i
        rows.where(mine).drop("_part").coalesce(1).write.parquet(f"{run}/in/p={i}")
    return f"{run}/in/p=*"


@query("stream_link", "select transaction_id, access_id, gap_seconds from pairs", "at", PAIRS)
def stream_link(spark, d):
    pairs = S.stream_link(views.project_access(_events(spark, d)), views.project_transactions(_events(spark, d)))
    return runs.drain(pairs.select("transaction_id", "access_id", "gap_seconds"), runs.new_run(spark))


@query("stream_structuring", "select transaction_id, cluster_count::int as cluster_count, aggregate_amount, matched::int as rule_matched from rule", "t", RULE)
def stream_structuring(spark, d):
    run = runs.new_run(spark)
    stream = readers.read_event_stream(spark, _shuffled(spark, d, run, late=False), txns(spark, d).schema, "parquet", max_files=1)
    out = runs.drain(S.stream_bursts(stream, window_s=BURST_S), run)
    return out.select("transaction_id", "cluster_count", "aggregate_amount", F.col("rule_matched").cast("int").alias("rule_matched"))


SLICES = 5
# Arrival: by slice of time, a quarter of the events one slice late; within a batch by time, accesses first.
ARRIVED = f"""ev as (select account_id, 'access' as kind, event_id::varchar as id, epoch_us(timestamp) as us from access_events union all select account_id, 'transaction', transaction_id, epoch_us(timestamp) from transactions),
lim as (select min(us) as lo, max(us) as hi from ev),
dealt as (select ev.*, least((us - lo) * {SLICES} // (hi - lo + 1), {SLICES - 1}) + case when ('0x' || substr(md5(kind || id), 1, 8))::bigint % 4 = 0 then 1 else 0 end as batch from ev, lim),
arrived as (select *, row_number() over (order by batch, us, kind, id) as seq from dealt),
marked as (select *, max(us) filter (where kind = 'access') over w as newest_access, max(us) filter (where kind = 'transaction') over w as newest_transaction
  from arrived window w as (partition by account_id order by seq rows between unbounded preceding and 1 preceding))"""


def _arriving(spark, d, run):
    """All events as a stream of one file a batch, in the order of ARRIVED."""
    rows = retention.events_of(access(spark, d), txns(spark, d))
    span = rows.agg(F.struct(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))).scalar()
    lo, hi = us(span["lo"], "a"), us(span["hi"], "b")
    late = F.conv(F.substring(F.md5(F.concat("kind", "id").cast("binary")), 1, 8), 16, 10).cast("long") % 4 == 0
    part = F.least(F.floor((us("timestamp", "c") - lo) * SLICES / (hi - lo + 1)), F.lit(SLICES - 1)) + late.cast("int")
    rows = rows.withColumn("_part", part.cast("int"))
    for i in range(SLICES + 1):
        rows.where(F.col("_part") == i).drop("_part").coalesce(1).write.parquet(f"{run}/in/p={i}")
    return readers.read_event_stream(spark, f"{run}/in/p=*", rows.drop("_part").schema, "parquet", max_files=1)


@query("stream_retention", f"""select l.account_id, case l.kind when 'transaction' then l.id else f.id end as transaction_id, case l.kind when 'transaction' then f.id else l.id end as access_id, abs(l.us - f.us) / 1e6 as gap_seconds
  from marked l join marked f on l.account_id = f.account_id and l.kind <> f.kind and f.seq < l.seq and abs(l.us - f.us) <= {4 * 3600 * 1000000}
  and f.us >= case l.kind when 'transaction' then l.newest_access else l.newest_transaction end - {24 * 3600 * 1000000}""", "at", ARRIVED)
def stream_retention(spark, d):
    """Events of a sparse table, so they are paired within four hours; most accounts have events that arrive after they are forgotten."""
    run = runs.new_run(spark)
    pairs = retention.remembered_pairs(_arriving(spark, d, run), window_s=4 * 3600.0, delay="400 days", spread=2)
    return runs.drain(pairs.select("account_id", "transaction_id", "access_id", "gap_seconds"), run)


PAID = """paid as (select *, epoch_us(timestamp) as us, ('0x' || substr(md5('transaction' || transaction_id), 1, 8))::bigint % 4 = 0 as slow from transactions),
lim as (select min(us) as lo, max(us) as hi from paid),
came as (select paid.*, least((us - lo) * 5 // (hi - lo + 1), 4) + slow::int as batch from paid, lim)"""


def _late_payments(spark, d, run):
    """The payments, a quarter of them a slice late, through the log of burst results."""
    rows = txns(spark, d)
    span = rows.agg(F.struct(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))).scalar()
    lo, hi = us(span["lo"], "a"), us(span["hi"], "b")
    slow = F.conv(F.substring(F.md5(F.concat(F.lit("transaction"), "transaction_id").cast("binary")), 1, 8), 16, 10).cast("long") % 4 == 0
    part = (F.least(F.floor((us("timestamp", "c") - lo) * SLICES / (hi - lo + 1)), F.lit(SLICES - 1)) + slow.cast("int")).cast("int")
    dealt = rows.withColumn("_part", part)
    slices = [dealt.where(F.col("_part") == i).drop("_part") for i in range(SLICES + 1)]
    runs.replay_slices(slices, run, corrections.burst_log(spark, f"{run}/store", BURST_S, DELAY_S), "transaction_id")
    return f"{run}/store"


DELAY_S = 6 * 3600.0


@query("stream_corrections", "select transaction_id, cluster_count::int as cluster_count, aggregate_amount, matched::int as rule_matched from rule", "t", RULE)
def stream_corrections(spark, d):
    """Results that hold once the log of all batches is summed up: late payments have changed those around them."""
    store = _late_payments(spark, d, runs.new_run(spark))
    log = corrections.current(corrections.stored(spark, f"{store}/log", corrections.LOG))
    return log.select("transaction_id", "cluster_count", "aggregate_amount", F.col("rule_matched").cast("int").alias("rule_matched"))


@query("stream_late_rows", f"""select batch::int as batch, count(*) as n_rows, count(*) filter (where us < high - {int(DELAY_S * 1e6)}) as n_late
  from (select came.*, (select max(x.us) from came x where x.batch < came.batch) as high from came) group by batch""", "t", PAID)
def stream_late_rows(spark, d):
    """How many rows of each batch came behind the watermark."""
    return corrections.counts(spark, _late_payments(spark, d, runs.new_run(spark)))


@query("stream_counters", """select 'access_events' as topic, count(*) as n_events, epoch_us(max(timestamp)) as last_us from access_events union all
  select 'transactions', count(*), epoch_us(max(timestamp)) from transactions""", "at")
def stream_counters(spark, d):
    run = runs.new_run(spark)
    runs.write_replay(access(spark, d), txns(spark, d), f"{run}/events", 2)
    runs.drain_batches(S.stream_counters(runs.read_replay(spark, f"{run}/events")), run, S.table_sink(f"{run}/counts"), mode="update")
    return S.newest(spark, f"{run}/counts", ["topic"]).select("topic", "n_events", us("last_seen", "last_us"))


@query("stream_reset", """select 'access_events' as topic, count(*) as n_events from access_events union all select 'transactions', count(*) from transactions""", "at")
def stream_reset(spark, d):
    """Counters after a reset: a run over some events is given up, and a fresh one counts all from the start."""
    a, t = access(spark, d), txns(spark, d)
    for rows in (t.where(F.pmod(F.crc32("transaction_id"), F.lit(2)) == 0), t):
        run = runs.new_run(spark)
        runs.write_replay(a, rows, f"{run}/events", 1)
        runs.drain_batches(S.stream_counters(runs.read_replay(spark, f"{run}/events")), run, S.table_sink(f"{run}/counts"), mode="update")
    return S.newest(spark, f"{run}/counts", ["topic"]).select("topic", "n_events")


@query("stream_nodes", "select src as account_id, count(*) as txn_count, round(sum(amount), 2) as total_outflow from edges where edge_type = 'TRANSFER' group by src", "at", EDGES)
def stream_nodes(spark, d):
    run = runs.new_run(spark)
    stream = readers.read_event_stream(spark, _shuffled(spark, d, run), txns(spark, d).schema, "parquet", max_files=1)
    runs.drain_batches(S.stream_nodes(stream), run, S.table_sink(f"{run}/nodes"), mode="update")
    return S.newest(spark, f"{run}/nodes", ["account_id"]).select("account_id", "txn_count", F.round("total_outflow", 2).alias("total_outflow"))


@query("stream_unique", "select transaction_id, amount from transactions", "t")
def stream_unique(spark, d):
    run = runs.new_run(spark)
    stream = readers.read_event_stream(spark, _shuffled(spark, d, run, repeat=True), txns(spark, d).schema, "parquet", max_files=1)
    return runs.drain(S.unique_transfers(stream, "400 days").select("transaction_id", "amount"), run)


@query("stream_alerts", "select alert_id, account_id, score as composite_risk_score, severity from alerts", "at", ALERTS)
def stream_alerts(spark, d):
    rows = S.stream_alerts(access(spark, d), txns(spark, d), runs.new_run(spark), BATCHES, BURST_S)
    return rows.select("alert_id", "account_id", "composite_risk_score", "severity")


@query("stream_rings", "select cycle_path, n::int as cycle_length, epoch_us(closed_at) as closed_us, ring_score from rings", "at", f"{ALL}, {CYCLES}, {RINGS}")
def stream_rings(spark, d):
    """Every ring, found when its last edge came."""
    run = runs.new_run(spark)
    S.stream_alerts(access(spark, d), txns(spark, d), run, BATCHES, BURST_S)
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{run}/store/rings").select("cycle_path", "cycle_length", us("closed_at", "closed_us"), "ring_score")
