"""Link pairs from per-account memory: what an account still remembers depends on its own newest events, not on the stream's.

An account keeps its accesses and its transactions apart. An event that arrives is paired with the remembered events of the other
kind at most ``window_s`` away, before or after it. An event is forgotten once the account's newest event of its own kind is more
than ``keep_s`` ahead of it, so a quiet account remembers for as long as it is quiet, and a busy one does not grow.

Accounts are dealt to groups, and a group's memory is read and written once for a batch that has events of it, whatever their number: a
batch costs what its rows and the memory of its groups cost. A timer clears what the watermark says can't be paired any more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracewell import constants as C
from tracewell.functions import columns as X

KINDS = ("access", "transaction")
EVENTS = "account_id string, kind string, id string, timestamp timestamp"
PAIRS = "account_id string, transaction_id string, access_id string, gap_seconds double, access_first boolean"
KEEP_SECONDS = C.BUFFER_HOURS * 3600.0
OUT = ["account_id", "transaction_id", "access_id", "gap_seconds", "access_first"]
EVENT_STATE = ["account_id", "kind", "id", "at"]
GROUPS, CHUNK = 256, 10_000  # keys that accounts are dealt to; rows of one entry of a state list
NEVER = np.iinfo(np.int64).min
HOME, NEAR, MARK = 0, 1, 2  # an event where it belongs; where it may be needed; where only its time counts


def events_of(access: DataFrame, txns: DataFrame) -> DataFrame:
    """Both tables as one: account_id, kind, id, timestamp."""
    left = access.select("account_id", F.lit(KINDS[0]).alias("kind"), F.col("event_id").cast("string").alias("id"), "timestamp")
    return left.unionByName(txns.select("account_id", F.lit(KINDS[1]).alias("kind"), F.col("transaction_id").alias("id"), "timestamp"))


class AccountMemory(StatefulProcessor):
    """Pairs the events of a group of accounts as they arrive, and forgets. The accounts are gone over together, in arrays."""

    def __init__(self, window_s: float, keep_s: float):
        self.window, self.keep = int(window_s * 1e6), int(keep_s * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "account_id array<string>, kind array<int>, id array<string>, at array<long>")
        self.newest = handle.getListState("newest", "account_id array<string>, access array<long>, transaction array<long>")

    def _read(self, state, names: list[str]) -> pd.DataFrame:
        parts = [pd.DataFrame(dict(zip(names, chunk, strict=True))) for chunk in state.get()] if state.exists() else []
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({c: np.zeros(0, object if c in ("account_id", "id") else np.int64) for c in names})

    def _write(self, state, names: list[str], rows: pd.DataFrame) -> None:
        if len(rows):
            state.put([tuple(part[c].tolist() for c in names) for part in (rows.iloc[k : k + CHUNK] for k in range(0, len(rows), CHUNK))])
        else:
            state.clear()

    def _pairs(self, ask: pd.DataFrame, pool: pd.DataFrame, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``ask`` and ``pool`` of the events to be paired; ``marks``: the newest event of the pool's kind before each row."""
        who, at, seq = (ask[c].to_numpy(np.int64) for c in ("who", "at", "seq"))
        owner, theirs, came = (pool[c].to_numpy(np.int64) for c in ("who", "at", "seq"))
        low = int(min(at.min(), theirs.min()))
        span = int(max(at.max(), theirs.max())) - low + 2 * self.window + 1
        one, two = [], []
        # Account and time make one number, for as many accounts at once as a long has room for.
        step = max(1, 2**62 // span)
        for start in range(0, int(who.max()) + 1, step):
            mine, other = (np.flatnonzero((x >= start) & (x < start + step)) for x in (who, owner))
            place, stood = ((x[i] - start) * span + (t[i] - low) for x, t, i in ((who, at, mine), (owner, theirs, other)))
            first, last = np.searchsorted(stood, place - self.window, "left"), np.searchsorted(stood, place + self.window, "right")
            n = last - first
            i = np.repeat(np.arange(len(mine)), n)
            j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
            one.append(mine[i])
            two.append(other[j])
        i, j = np.concatenate(one), np.concatenate(two)
        mark = marks[seq[i]]
        ok = (came[j] < seq[i]) & ((mark == NEVER) | (theirs[j] >= np.where(mark == NEVER, 0, mark) - self.keep))
        return i[ok], j[ok]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows), ignore_index=True)
        every["kind"] = (every["kind"] == KINDS[1]).astype(np.int64)
        known = self._read(self.newest, ["account_id", *KINDS])
        memory = self._read(self.events, EVENT_STATE)
        # Numbers for all accounts that are known or come now; those that are known come first, in their order.
        who, accounts = pd.factorize(pd.concat([known["account_id"], every["account_id"]], ignore_index=True))
        every["who"] = who[len(known) :]
        memory["who"] = pd.Index(accounts).get_indexer(memory["account_id"])
        # Rows of one batch arrive in time order, accesses first.
        every = every.sort_values(["who", "at", "kind", "id"], kind="stable").reset_index(drop=True)
        every["seq"] = np.arange(len(every))
        memory["seq"] = -1
        marks, newest = [], []
        for k in (0, 1):
            # The newest of a kind before each row of the batch, and after all.
            start = np.full(len(accounts), NEVER)
            start[: len(known)] = known[KINDS[k]].to_numpy(np.int64)
            at = pd.Series(np.where(every["kind"] == k, every["at"], NEVER))
            so_far = at.groupby(every["who"].to_numpy()).cummax()
            before = so_far.groupby(every["who"].to_numpy()).shift(1, fill_value=NEVER).to_numpy(np.int64)
            marks.append(np.maximum(before, start[every["who"]]))
            end = start.copy()
            np.maximum.at(end, every["who"].to_numpy(), at.to_numpy(np.int64))
            newest.append(end)
        held = every[every["role"] != MARK]
        out = []
        for mine, other in ((0, 1), (1, 0)):
            ask = held[(held["kind"] == mine) & (held["role"] == HOME)]
            pool = pd.concat([memory[memory["kind"] == other], held[held["kind"] == other]])[["account_id", "id", "at", "seq", "who"]].sort_values(["who", "at"], kind="stable")
            if not len(ask) or not len(pool):
                continue
            i, j = self._pairs(ask, pool, marks[other])
            a, b = ask.iloc[i], pool.iloc[j]
            txn, acc = (a, b) if mine == 1 else (b, a)
            gap = acc["at"].to_numpy(np.int64) - txn["at"].to_numpy(np.int64)
            out.append(pd.DataFrame({"account_id": a["account_id"].to_numpy(), "transaction_id": txn["id"].to_numpy(), "access_id": acc["id"].to_numpy(), "gap_seconds": np.abs(gap) / 1e6, "access_first": gap <= 0}))
        self._write(self.newest, ["account_id", *KINDS], pd.DataFrame({"account_id": accounts, KINDS[0]: newest[0], KINDS[1]: newest[1]}))
        self._keep(pd.concat([memory, held])[[*EVENT_STATE, "who"]], newest, timerValues)
        yield pd.concat(out) if out else pd.DataFrame(columns=OUT)

    def _keep(self, rows: pd.DataFrame, newest: list[np.ndarray], timerValues) -> None:
        """Stores the events that are not forgotten, and sets a timer for when the last of them can be."""
        who, latest = rows["who"].to_numpy(np.int64), np.maximum(*newest)
        mark = np.where(rows["kind"].to_numpy(np.int64) == 0, newest[0][who], newest[1][who])
        # Nothing that comes after the watermark can be paired with what is a window behind it.
        alive = (rows["at"].to_numpy(np.int64) >= mark - self.keep) & (latest[who] + self.window > timerValues.getCurrentWatermarkInMs() * 1000)
        self._write(self.events, EVENT_STATE, rows[alive])
        if alive.any():
            end = int(latest[who[alive]].max()) + self.window
            self.handle.registerTimer(-(-end // 3_600_000_000) * 3_600_000)  # whole hours: one timer for many batches

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known, memory = self._read(self.newest, ["account_id", *KINDS]), self._read(self.events, EVENT_STATE)
        if len(memory):
            memory["who"] = pd.Index(known["account_id"]).get_indexer(memory["account_id"])
            self._keep(memory, [known[k].to_numpy(np.int64) for k in KINDS], timerValues)
        yield pd.DataFrame(columns=OUT)

    def close(self) -> None:
        pass


def remembered_pairs(events: DataFrame, window_s: float = C.LINK_WINDOW_SECONDS, keep_s: float = KEEP_SECONDS, delay: str = "24 hours", spread: int = 1) -> DataFrame:
    """Pairs of access and transaction, each when its later event arrives, for a stream of :func:`events_of` rows.

    Events later than ``delay`` are dropped by the watermark. ``spread``: over how many keys an account is dealt; its events go to
    the key of their hour (and of the next one, near an hour's end), their times to all, so that each key knows what is newest.
    A NULL account, id or time is never paired.
    """
    us = X.micros("timestamp")
    fed = events.where("account_id is not null and id is not null and timestamp is not null").withWatermark("timestamp", delay).withColumn("at", us)
    width = max(3_600_000_000, int(2 * window_s * 1e6))
    key_of = lambda t: F.pmod(F.floor(t / F.lit(width)).cast("long"), F.lit(spread))
    home, low, high = key_of(F.col("at")), key_of(F.col("at") - int(window_s * 1e6)), key_of(F.col("at") + int(window_s * 1e6))
    role = lambda s: F.when(s == home, HOME).when((s == low) | (s == high), NEAR).otherwise(MARK)
    keys = F.sequence(F.lit(0).cast("long"), F.lit(spread - 1).cast("long"))
    dealt = fed.select("account_id", "kind", "id", "timestamp", "at", F.explode(F.transform(keys, lambda s: F.struct(s.alias("part"), role(s).alias("role")))).alias("_p"))
    return dealt.select(F.pmod(F.xxhash64("account_id"), F.lit(GROUPS)).cast("int").alias("members"), "account_id", "_p.part", "kind", "id", "timestamp", "at", "_p.role").groupBy("members", "part").transformWithStateInPandas(
        statefulProcessor=AccountMemory(window_s, keep_s), outputStructType=PAIRS, outputMode="append", timeMode="EventTime")
