"""Stream forms of the detectors: link join, burst buffer, counters, alert batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracewell import constants as C
from tracewell import schemas
from tracewell.functions import columns as X
from tracewell.operators import detect as D
from tracewell.operators import links as L
from tracewell.operators import profile as P
from tracewell.operators import risk as K
from tracewell.streaming import accounts, rings, runs


def stream_link(access: DataFrame, txns: DataFrame, window_s: float = C.LINK_WINDOW_SECONDS, delay: str = "24 hours") -> DataFrame:
    """Pairs of both streams at most ``window_s`` apart.

    Rows wait in state under (account, time bucket) until the watermark, ``delay`` behind, passes their window;
    events later than that are dropped and counted by the query's progress.
    """
    left, right = L.bucketed(access.withWatermark("timestamp", delay), txns.withWatermark("timestamp", delay), window_s)
    pairs = right.join(left, ["account_id", "_bucket"]).where(L.in_window(window_s)).drop("_bucket")
    return L.with_gap(pairs)


PARTS = 512  # keys that the accounts of a time slice are dealt to
CHUNK = 10_000  # rows of one entry of a state list


def _sums(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Sums of ``values[lo:hi]``, each of its own values only: a running total over many accounts would lose digits."""
    cut = np.empty(2 * len(lo), np.int64)
    cut[0::2], cut[1::2] = lo, hi
    return np.add.reduceat(np.append(values, 0.0), cut)[0::2] if len(lo) else np.zeros(0)


class BurstBuffer(StatefulProcessor):
    """Keeps the last rows of a part of the accounts and applies the burst rule to every row that arrives.

    A part's accounts are gone over together, in arrays, so that a batch costs what its rows cost and not a call for each account.
    """

    def __init__(self, window_s: float, keep: int, limit: float, min_n: int, floor: float, slice_s: float):
        self.window = int(window_s * 1e6)
        self.keep, self.limit, self.min_n, self.floor = keep, limit, min_n, floor
        self.slice_s = slice_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", schemas.BURST_BUFFER)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = ["account_id", "transaction_id", "at", "amount"]
        fresh = pd.concat(list(rows))
        fresh = fresh.assign(at=fresh["timestamp"].to_numpy("datetime64[us]").astype(np.int64), new=~fresh["repeat"].astype(bool))[[*names, "new"]]
        if self.rows.exists():
            seen = [pd.DataFrame(dict(zip(names, chunk, strict=True))).assign(new=False) for chunk in self.rows.get()]
            fresh = pd.concat([*seen, fresh])
        every = fresh.assign(who=pd.factorize(fresh["account_id"], use_na_sentinel=False)[0]).sort_values(["who", "at", "transaction_id"], kind="stable").reset_index(drop=True)
        at, who = every["at"].to_numpy(np.int64), every["who"].to_numpy(np.int64)
        small = every["amount"].to_numpy(float)
        below = small < self.limit  # false where there is no amount
        count = np.concatenate([[0], np.cumsum(below)])
        ask = np.flatnonzero(every["new"].to_numpy(bool))
        # A row sees its window, as far back as its account's last ``keep`` rows, whenever it arrives. Times lie near the slice, so
        # account and time make one number.
        low = at.min() - self.window
        place = who * (at.max() - low + 1) + (at - low)
        lo = np.maximum(np.searchsorted(place, place[ask] - self.window, "left"), np.maximum(ask + 1 - self.keep, np.searchsorted(who, who[ask], "left")))
        n, amount = count[ask + 1] - count[lo], np.round(_sums(np.where(below, small, 0.0), lo, ask + 1), 2)
        mine = every.iloc[ask]
        out = pd.DataFrame({"a": mine["account_id"], "s": int(key[1]), "t": mine["transaction_id"], "ts": pd.to_datetime(at[ask], unit="us"), "m": mine["amount"], "n": n, "sum": amount,
                            "hit": (n >= self.min_n) & (amount >= self.floor)})
        # Rows that a later one may still look back to: it can't be older than the watermark.
        kept = every[at >= max(timerValues.getCurrentWatermarkInMs(), 0) * 1000 - self.window]
        self.rows.put([tuple(chunk[c].tolist() for c in names) for chunk in (kept.iloc[k : k + CHUNK] for k in range(0, len(kept), CHUNK))])
        # The slice's state goes once the watermark is a slice past its end.
        self.handle.registerTimer(int((key[1] + 2) * self.slice_s * 1000))
        out.columns = schemas.BURST_OUT.names
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.rows.clear()
        yield pd.DataFrame(columns=schemas.BURST_OUT.names)

    def close(self) -> None:
        pass


def stream_bursts(txns: DataFrame, window_s: float = C.BURST_WINDOW_SECONDS, keep: int = C.BUFFER_ROWS, limit: float = C.REPORTING_LIMIT,
                  min_n: int = C.BURST_MIN_ROWS, factor: float = C.BURST_FACTOR, delay: str = "24 hours") -> DataFrame:
    """Burst rule on every transaction of a stream.

    State is kept by part of the accounts and time slice; rows near a slice's end are sent to the next slice too, so a
    busy account's history is spread over keys and old slices expire whole.
    """
    slice_s = 10 * window_s
    slot = lambda us: F.floor(us / F.lit(int(slice_s * 1e6))).cast("long")
    us = X.micros("timestamp")
    fed = (txns.withWatermark("timestamp", delay)
           .select(F.pmod(F.xxhash64("account_id"), F.lit(PARTS)).cast("int").alias("part"), "account_id", "transaction_id", "timestamp", "amount", slot(us).alias("_home"),
                   F.explode(F.sequence(slot(us), slot(us + int(window_s * 1e6)))).alias("slice"))
           .withColumn("repeat", F.col("slice") != F.col("_home")).drop("_home"))
    return fed.groupBy("part", "slice").transformWithStateInPandas(
        statefulProcessor=BurstBuffer(window_s, keep, limit, min_n, limit * factor, slice_s),
        outputStructType=schemas.BURST_OUT, outputMode="append", timeMode="EventTime")


def stream_counters(events: DataFrame) -> DataFrame:
    """Running event counts per topic."""
    return events.groupBy(X.route_topic("topic").alias("topic")).agg(F.count(F.lit(1)).alias("n_events"), F.max("timestamp").alias("last_seen"))


def stream_nodes(txns: DataFrame) -> DataFrame:
    """Running transfer counters per account, for update or complete mode."""
    return txns.groupBy("account_id").agg(F.count(F.lit(1)).alias("txn_count"), F.sum("amount").alias("total_outflow"), F.max("timestamp").alias("last_seen"))


def table_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Keeps the rows that each batch changed in ``path``/batch=<batch>; a batch that runs again overwrites its own."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return write


def newest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The table that update-mode batches of :func:`table_sink` make: of each key the row of its last batch."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r"))
    return last.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def unique_transfers(txns: DataFrame, delay: str = "24 hours") -> DataFrame:
    """Repeated transaction ids within the watermark are dropped."""
    return txns.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["transaction_id"])


def alert_batch(spark: SparkSession, store: str, out: str, burst_window_s: float = C.BURST_WINDOW_SECONDS,
                use_label_flag: bool = True) -> Callable[[DataFrame, int], None]:
    """foreachBatch function for :func:`accounts.account_stream`: rings that a batch closes, then the alerts of its events.

    What an account's past says comes with each event, so no stored event is read. Rings are found from the batch's new edges.
    A batch that runs again overwrites its own folders.
    """
    kept = rings.Store(spark, store)

    def each(batch: DataFrame, batch_id: int) -> None:
        kept.begin(batch_id)
        rows = kept.write("events", batch, batch_id)
        payments, seen = rows.where("kind = 'transaction'"), rows.where("kind = 'access'")
        closed = rings.update(kept, payments.select(
            F.col("account_id").alias("src"), F.col("t_counterparty_id").alias("dst"), F.col("pair_amount").alias("amount"),
            F.timestamp_micros("pair_first_us").alias("first_ts"), F.col("at").alias("seen"), F.struct("at", "t_transaction_id").alias("turn")), batch_id)
        first = rings.first_by_account(kept, closed, payments, batch_id)
        signals = D.both_kinds(_payment_signals(payments, first, burst_window_s), _access_signals(seen))
        alerts = K.build_alerts(signals, ["source", "source_id"], use_label_flag)
        alerts.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        kept.end(batch_id)

    return each


def _unpacked(prefix: str, columns: dict[str, str], names: dict[str, str]) -> list:
    """The columns of one kind without their prefix, times as times, under the names that pairs have them by."""
    shown = {c: c.removeprefix(prefix) for c in columns if c != f"{prefix}account_id"}
    typed = lambda c: F.timestamp_micros(c) if c.endswith("timestamp") else F.col(c).cast("long") if c == "a_event_id" else F.col(c)
    return [typed(c).alias(names.get(n, n)) for c, n in shown.items()]


_AS_ACCESS = {"event_id": "access_id", "timestamp": "access_ts", "branch_code": "access_branch"}
_AS_PAYMENT = {"timestamp": "txn_ts", "branch_code": "txn_branch"}


def _payment_signals(payments: DataFrame, first: DataFrame, burst_window_s: float) -> DataFrame:
    rows = payments.select("account_id", *_unpacked("t_", accounts.PAYMENT, {}), *accounts.PAST, *[c for c in accounts.ACCESS])
    rows = rows.withColumn("rule_matched", (F.col("cluster_count") >= C.BURST_MIN_ROWS) & (F.col("aggregate_amount") >= C.REPORTING_LIMIT * C.BURST_FACTOR))
    rows = D.with_rings(P.profile_score(P.from_past(rows.withColumn("aggregate_amount", F.round("aggregate_amount", 2)))), first)
    pay = [f.name for f in schemas.TRANSACTIONS.fields]
    rows = rows.select(*[F.col(c).alias(_AS_PAYMENT.get(c, c)) for c in pay], *D.SCORED, *D.RING, *_unpacked("a_", accounts.ACCESS, _AS_ACCESS))
    return D.paired_payments(rows.withColumn("_linked", F.col("access_id").isNotNull()), burst_window_s)


def _access_signals(seen: DataFrame) -> DataFrame:
    rows = seen.select("account_id", *_unpacked("a_", accounts.ACCESS, _AS_ACCESS), *_unpacked("t_", accounts.PAYMENT, _AS_PAYMENT))
    return D.paired_accesses(rows.withColumn("_linked", F.col("transaction_id").isNotNull()))


def stream_alerts(access: DataFrame, txns: DataFrame, run: str, chunks: int = 4, burst_window_s: float = C.BURST_WINDOW_SECONDS, use_label_flag: bool = True) -> DataFrame:
    """Replays both tables in ``chunks`` batches through the account state and reads their alerts back."""
    spark = access.sparkSession
    runs.replay(access, txns, run, alert_batch(spark, f"{run}/store", f"{run}/alerts", burst_window_s, use_label_flag), chunks,
                through=lambda lines: accounts.account_stream(accounts.tagged_events(lines), burst_window_s))
    return spark.read.parquet(f"{run}/alerts")
