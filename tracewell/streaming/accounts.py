"""What an account's past says about each of its events, kept as state that is merged with new events only.

The state of an account is small and of fixed kinds: count, mean, squared deviations, maximum, first and last time and last channel of
its payments; what it has paid to each counterparty; its last payments, as far as the burst rule looks back; its accesses and
payments inside the link window. An event costs the same whether the account has ten payments behind it or ten million, and no
event is read again once it has left the window. Accounts are dealt to groups, and a batch reads and writes the state of the groups
it has events of once.

Batches are taken to come in time order, as a replay does; rows of a batch are put in order. Late events: :mod:`corrections`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracewell import constants as C
from tracewell import schemas
from tracewell.functions import columns as X

PAST = {"historical_txn_count": "double", "historical_mean_amount": "double", "historical_std_amount": "double", "historical_max_amount": "double",
        "account_age_steps": "double", "days_since_last_transaction": "double", "type_matches_history": "double", "is_new_counterparty": "double",
        "cluster_count": "int", "aggregate_amount": "double", "pair_amount": "double", "pair_first_us": "long"}
_SQL_TYPES = {T.StringType(): "string", T.DoubleType(): "double", T.IntegerType(): "int", T.LongType(): "long", T.TimestampType(): "timestamp"}


def _fields(prefix: str, schema: T.StructType) -> dict[str, str]:
    return {f"{prefix}{f.name}": "long" if f.dataType == T.TimestampType() else _SQL_TYPES[f.dataType] for f in schema.fields}


# Ids are text: numbers that may be missing travel as doubles, which can't hold all of them.
ACCESS = {"a_event_id": "string", **_fields("a_", schemas.ACCESS)}
PAYMENT = _fields("t_", schemas.TRANSACTIONS)
EVENT = {"kind": "string", "account_id": "string", "at": "long", "turn": "string"}
OUT = {**EVENT, **ACCESS, **PAYMENT, **PAST}


def _ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"{n} {t}" for n, t in columns.items())


def events(access: DataFrame, txns: DataFrame) -> DataFrame:
    """Both tables, or streams, as one: ``EVENT`` columns, an access's fields as a_*, a payment's as t_*; times in microseconds."""
    def side(df: DataFrame, kind: str, prefix: str, columns: dict[str, str]) -> DataFrame:
        shown = {c: X.micros(c.removeprefix(prefix)) if c.endswith("timestamp") else F.col(c.removeprefix(prefix)) for c in columns}
        every = {**{c: F.lit(None) for c in (ACCESS if prefix == "t_" else PAYMENT)}, **shown}
        # Equal times: by id, numbers as numbers.
        turn = F.col("transaction_id") if prefix == "t_" else F.lpad(F.col("event_id").cast("string"), 20, "0")
        return df.select(F.lit(kind).alias("kind"), F.col("account_id"), X.micros("timestamp").alias("at"), turn.alias("turn"), *[every[c].cast({**ACCESS, **PAYMENT}[c]).alias(c) for c in {**ACCESS, **PAYMENT}])

    return side(access, "access", "a_", ACCESS).unionByName(side(txns, "transaction", "t_", PAYMENT))


def tagged_events(lines: DataFrame) -> DataFrame:
    """:func:`events` of tagged JSON lines, a table or a stream. Both kinds are decoded in one pass: a union of the two would read every line twice."""
    topic = X.route_topic("topic")
    payload = lambda name, schema: F.from_json(F.when(topic == name, F.col("payload")), schema)
    rows = lines.where(topic.isin("access_events", "transactions")).select(
        (topic == "access_events").alias("_seen"), "event_key", payload("access_events", schemas.ACCESS).alias("_a"), payload("transactions", schemas.TRANSACTIONS).alias("_t"))
    event_id = F.when(F.col("_seen"), F.col("event_key")).cast("long").cast("string")
    field = lambda c: event_id if c == "a_event_id" else X.micros(f"_{c[0]}.{c[2:]}") if c.endswith("timestamp") else F.col(f"_{c[0]}.{c[2:]}")
    own = {"kind": F.when(F.col("_seen"), "access").otherwise("transaction"), "account_id": F.when(F.col("_seen"), F.col("_a.account_id")).otherwise(F.col("_t.account_id")),
           "at": F.when(F.col("_seen"), X.micros("_a.timestamp")).otherwise(X.micros("_t.timestamp")), "turn": F.when(F.col("_seen"), F.lpad(event_id, 20, "0")).otherwise(F.col("_t.transaction_id"))}
    return rows.select(*[own[c].alias(c) for c in EVENT], *[field(c).cast(t).alias(c) for c, t in {**ACCESS, **PAYMENT}.items()])


GROUPS, CHUNK = 256, 10_000  # keys that accounts are dealt to; rows of one entry of a state list
PROFILE = {"account_id": "string", "n": "long", "k": "long", "mean": "double", "m2": "double", "top": "double", "first": "long", "last": "long", "type": "string"}
PAID = {"account_id": "string", "counterparty": "string", "amount": "double", "first": "long"}
RECENT = {"account_id": "string", "at": "long", "amount": "double"}
_DTYPES = {"string": np.dtype(object), "double": np.dtype(float), "int": pd.Int32Dtype(), "long": pd.Int64Dtype()}


def _typed(rows: pd.DataFrame, columns: dict[str, str]) -> pd.DataFrame:
    """The columns in types that hold missing values; only those that have another type are converted."""
    return pd.DataFrame({c: _cast(rows[c], t) for c, t in columns.items()}, copy=False)


def _cast(column: pd.Series, kind: str) -> pd.Series:
    return column if column.dtype == _DTYPES[kind] else column.astype(_DTYPES[kind])


def _stacked(parts: list[pd.DataFrame], columns: dict[str, str]) -> pd.DataFrame:
    """The parts' rows one after the other, each column put together once; what a part lacks is missing."""
    def of(part: pd.DataFrame, c: str, t: str) -> pd.Series:
        none = {"string": None, "double": np.nan}.get(t, pd.NA)
        return _cast(part[c], t) if c in part.columns else pd.Series([none] * len(part), dtype=_DTYPES[t])

    return pd.DataFrame({c: pd.concat([of(p, c, t) for p in parts], ignore_index=True) for c, t in columns.items()}, copy=False)


def _list_of(columns: dict[str, str]) -> str:
    return ", ".join(f"{n} array<{t}>" for n, t in columns.items())


def _read(state, columns: dict[str, str]) -> pd.DataFrame:
    """What :func:`_write` has put, its chunks' lists joined column by column."""
    held = {c: [] for c in columns}
    for chunk in state.get() if state.exists() else ():
        for c, values in zip(columns, chunk, strict=True):
            held[c].extend(values)
    return pd.DataFrame({c: pd.Series(held[c], dtype=_DTYPES[t]) for c, t in columns.items()}, copy=False)


def _plain(column: pd.Series) -> list:
    """Plain Python values, None for what is missing."""
    missing = column.isna().to_numpy()
    if not missing.any():
        return column.tolist()
    values = column.to_numpy(object, copy=True)
    values[missing] = None
    return values.tolist()


def _write(state, columns: dict[str, str], rows: pd.DataFrame) -> None:
    if len(rows):
        plain = {c: _plain(rows[c]) for c in columns}
        state.put([tuple(plain[c][k : k + CHUNK] for c in columns) for k in range(0, len(rows), CHUNK)])
    else:
        state.clear()


def _from(who: np.ndarray, at: np.ndarray, asks: np.ndarray, since: np.ndarray) -> np.ndarray:
    """Of rows in the order of (who, at): the first place of account ``asks`` that is not before ``since``, or where it would be."""
    times = np.unique(at)
    step = len(times) + 1
    return np.searchsorted(who * step + np.searchsorted(times, at), asks * step + np.searchsorted(times, since))


class AccountState(StatefulProcessor):
    """Adds to every event of a group of accounts what its account's state says, then merges the events into the state.

    The accounts are gone over together, in arrays, so that a batch costs what its rows and the state of its groups cost and not
    a call for each account.
    """

    def __init__(self, burst_s: float, link_s: float, keep: int, buffer_s: float, limit: float):
        self.burst, self.link, self.buffer = int(burst_s * 1e6), int(link_s * 1e6), int(buffer_s * 1e6)
        self.keep, self.limit = keep, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.profile = handle.getListState("profile", _list_of(PROFILE))
        self.paid = handle.getListState("paid", _list_of(PAID))
        self.recent = handle.getListState("recent", _list_of(RECENT))
        self.accesses = handle.getListState("accesses", _list_of(ACCESS))
        self.payments = handle.getListState("payments", _list_of(PAYMENT))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = _typed(pd.concat(list(rows), ignore_index=True), {**EVENT, **ACCESS, **PAYMENT})
        profile, accesses, payments = _read(self.profile, PROFILE), _read(self.accesses, ACCESS), _read(self.payments, PAYMENT)
        # Numbers for all accounts that are known or come now.
        accounts = pd.Index(pd.unique(pd.concat([profile["account_id"], accesses["a_account_id"], payments["t_account_id"], fresh["account_id"]])))
        fresh["who"], accesses["who"], payments["who"] = (accounts.get_indexer(x) for x in (fresh["account_id"], accesses["a_account_id"], payments["t_account_id"]))
        fresh = fresh.sort_values(["who", "at", "kind", "turn"], kind="stable")
        seen, paid = (fresh[fresh["kind"] == k].reset_index(drop=True) for k in ("access", "transaction"))
        # Accesses come before payments of the same time; of equal times the smallest id is first.
        accesses, payments = pd.concat([accesses, seen[[*ACCESS, "who"]]]), pd.concat([payments, paid[[*PAYMENT, "who"]]])
        accesses = accesses.assign(_id=accesses["a_event_id"].astype("string").str.rjust(20)).sort_values(["who", "a_timestamp", "_id"], kind="stable").reset_index(drop=True)
        payments = payments.sort_values(["who", "t_timestamp", "t_transaction_id"], kind="stable").reset_index(drop=True)
        linked = self._first_near(seen, payments, "t_timestamp", 1), self._first_near(paid, accesses, "a_timestamp", 0)
        out = [pd.concat([seen[[*EVENT, *ACCESS]], linked[0][[*PAYMENT]]], axis=1),
               pd.concat([paid[[*EVENT, *PAYMENT]], linked[1][[*ACCESS]], *([self._past(paid, profile, accounts)] if len(paid) else [])], axis=1)]
        newest = np.full(len(accounts), np.iinfo(np.int64).min + self.link)
        np.maximum.at(newest, fresh["who"].to_numpy(), fresh["at"].to_numpy(np.int64))
        for state, columns, held, at in ((self.accesses, ACCESS, accesses, "a_timestamp"), (self.payments, PAYMENT, payments, "t_timestamp")):
            _write(state, columns, held[held[at].to_numpy(np.int64) >= newest[held["who"].to_numpy()] - self.link])
        yield _stacked([x for x in out if len(x)], OUT)

    def _first_near(self, events_: pd.DataFrame, others: pd.DataFrame, column: str, before: int) -> pd.DataFrame:
        """For each event its account's first row of the other kind in the link window, at least ``before`` microseconds earlier."""
        who, now = events_["who"].to_numpy(np.int64), events_["at"].to_numpy(np.int64)
        owner, at = others["who"].to_numpy(np.int64), others[column].to_numpy(np.int64)
        place = _from(owner, at, who, now - self.link)
        there = np.append(owner, -1)[place] == who
        return others.reindex(np.where(there & (np.append(at, 0)[place] <= now - before), place, -1)).reset_index(drop=True)

    def _past(self, paid: pd.DataFrame, profile: pd.DataFrame, accounts: pd.Index) -> pd.DataFrame:
        """``PAST`` of payments in order; their account's profile, totals by counterparty and last payments are brought up to date."""
        who, now, amount = paid["who"].to_numpy(np.int64), paid["at"].to_numpy(np.int64), paid["t_amount"].to_numpy(float)
        by = lambda values: pd.Series(values).groupby(who)
        of = profile.set_index("account_id").reindex(accounts)
        n0, k0, mean0, m20 = (of[c].fillna(0).to_numpy(t) for c, t in (("n", np.int64), ("k", np.int64), ("mean", float), ("m2", float)))
        known = n0 > 0
        is_first, is_last = np.diff(who, prepend=-1) != 0, np.diff(who, append=-1) != 0
        nth = np.arange(len(who)) - np.flatnonzero(is_first)[np.cumsum(is_first) - 1]
        has = ~np.isnan(amount)
        # Sums of differences from the mean so far, or from the first amount: their digits are not lost in the amounts' own size.
        some, begin = np.flatnonzero(has)[::-1], np.zeros(len(accounts))
        begin[who[some]] = amount[some]
        base = np.where(k0 > 0, mean0, begin)
        off = np.where(has, amount - base[who], 0.0)
        k, s1, s2 = k0[who] + by(has.astype(np.int64)).cumsum().to_numpy(), by(off).cumsum().to_numpy(), by(off * off).cumsum().to_numpy()
        top = np.fmax(by(np.where(has, amount, -np.inf)).cummax().to_numpy(), of["top"].fillna(-np.inf).to_numpy(float)[who])

        def before(values: np.ndarray, start: np.ndarray) -> np.ndarray:
            """The values of the account's payment before, or what its state has."""
            return np.where(is_first, start[who], np.concatenate([values[:1], values[:-1]]))

        none = np.zeros(len(accounts))
        k_, s1_, s2_ = before(k, k0), before(s1, none), before(s2, none)
        top_ = before(top, of["top"].fillna(-np.inf).to_numpy(float))
        mean_ = np.where(k_ > 0, base[who] + s1_ / np.maximum(k_, 1), 0.0)
        std_ = np.where(k_ > 1, np.sqrt(np.maximum(m20[who] + s2_ - s1_ * s1_ / np.maximum(k_, 1), 0.0) / np.maximum(k_ - 1, 1)), 0.0)
        opened = np.where(known, of["first"].fillna(0).to_numpy(np.int64), 0)
        opened[who[is_first & ~known[who]]] = now[is_first & ~known[who]]
        last_ = before(now, of["last"].fillna(0).to_numpy(np.int64))
        n_ = n0[who] + nth
        channel = paid["t_transaction_type"].to_numpy(object)
        channel_ = before(channel, of["type"].to_numpy(object))
        same = pd.Series(channel_).notna().to_numpy() & (channel_ == channel)
        past = {"historical_txn_count": n_.astype(float), "historical_mean_amount": mean_, "historical_std_amount": std_, "historical_max_amount": np.where(np.isneginf(top_), 0.0, top_),
                "account_age_steps": (now - opened[who]) / 3.6e9, "days_since_last_transaction": np.where(n_ > 0, (now - last_) / 8.64e10, 999.0),
                "type_matches_history": ((n_ > 0) & same).astype(float)}
        end = np.flatnonzero(is_last)
        mine = who[end]
        fresh = pd.DataFrame({"account_id": accounts[mine], "n": n_[end] + 1, "k": k[end], "mean": np.where(k[end] > 0, base[mine] + s1[end] / np.maximum(k[end], 1), 0.0),
                              "m2": np.maximum(m20[mine] + s2[end] - s1[end] ** 2 / np.maximum(k[end], 1), 0.0), "top": np.where(np.isneginf(top[end]), np.nan, top[end]),
                              "first": opened[mine], "last": now[end], "type": channel[end]})
        kept = profile[~profile["account_id"].isin(fresh["account_id"])]
        _write(self.profile, PROFILE, pd.concat([kept, _typed(fresh, PROFILE)]) if len(kept) else fresh)
        return pd.DataFrame({**past, **self._pairs(paid, who, now, amount, accounts), **self._bursts(paid, who, now, amount, accounts)})

    def _pairs(self, paid: pd.DataFrame, who: np.ndarray, now: np.ndarray, amount: np.ndarray, accounts: pd.Index) -> dict[str, np.ndarray]:
        """Running totals and first times by counterparty."""
        held = _read(self.paid, PAID)
        other = paid["t_counterparty_id"]
        names = ("=" + other).where(other.notna(), "-")
        code, uniques = pd.factorize(pd.concat([held["counterparty"], names], ignore_index=True))
        owner = np.concatenate([accounts.get_indexer(held["account_id"]), who])
        pair, _ = pd.factorize(owner.astype(np.int64) * len(uniques) + code)
        m, mine = len(held), pair[len(held):]
        count = int(pair.max()) + 1
        start, first = np.zeros(count), np.zeros(count, np.int64)
        start[pair[:m]], first[pair[:m]] = held["amount"].to_numpy(float), held["first"].to_numpy(np.int64)
        groups = pd.Series(np.where(np.isnan(amount), 0.0, amount)).groupby(mine)
        new = (mine >= m) & (groups.cumcount().to_numpy() == 0)
        first[mine[new]] = now[new]
        total = start[mine] + groups.cumsum().to_numpy()
        start[mine] = total  # of a pair's payments the last one stays
        at = np.flatnonzero(new)
        rows = pd.concat([held[["account_id", "counterparty"]], pd.DataFrame({"account_id": accounts[who[at]], "counterparty": names.to_numpy(object)[at]})], ignore_index=True)
        place = np.concatenate([pair[:m], mine[at]])
        _write(self.paid, PAID, rows.assign(amount=start[place], first=first[place]))
        return {"is_new_counterparty": new.astype(float), "pair_amount": total, "pair_first_us": first[mine]}

    def _bursts(self, paid: pd.DataFrame, who: np.ndarray, now: np.ndarray, amount: np.ndarray, accounts: pd.Index) -> dict[str, np.ndarray]:
        """Number and sum of the amounts below the limit in the burst window, as far back as the account's last ``keep`` payments."""
        held = _read(self.recent, RECENT)
        m = len(held)
        owner = np.concatenate([accounts.get_indexer(held["account_id"]), who]).astype(np.int64)
        at, value = np.concatenate([held["at"].to_numpy(np.int64), now]), np.concatenate([held["amount"].to_numpy(float), amount])
        order = np.lexsort((at, owner))  # stable: what is stored comes before the batch
        owner, at, value = owner[order], at[order], value[order]
        ask = np.empty(len(who), np.int64)
        ask[order[order >= m] - m] = np.flatnonzero(order >= m)
        lo = np.maximum(_from(owner, at, who, now - min(self.burst, self.buffer)), ask + 1 - self.keep)
        small = value < self.limit  # false where there is no amount
        count, total = np.zeros(len(ask), np.int64), np.zeros(len(ask))
        for back in range(int((ask - lo).max()), -1, -1):
            there = np.flatnonzero(ask - back >= lo)
            hit = there[small[ask[there] - back]]
            count[hit] += 1
            total[hit] += value[ask[hit] - back]
        left = pd.Series(owner).groupby(owner).cumcount(ascending=False).to_numpy() < self.keep
        _write(self.recent, RECENT, pd.DataFrame({"account_id": accounts[owner[left]], "at": at[left], "amount": value[left]}))
        return {"cluster_count": count, "aggregate_amount": total}

    def close(self) -> None:
        pass


def account_stream(events_: DataFrame, burst_s: float = C.BURST_WINDOW_SECONDS, link_s: float = C.LINK_WINDOW_SECONDS, keep: int = C.BUFFER_ROWS,
                   buffer_s: float = C.BUFFER_HOURS * 3600.0, limit: float = C.REPORTING_LIMIT) -> DataFrame:
    """A stream of :func:`events` rows with ``PAST``: for a payment the account's past and the first access in the link window before
    it (as a_* columns), for an access the first payment in the window before it (as t_* columns). NULL accounts or times are left out."""
    fed = events_.where("account_id is not null and at is not null")
    return fed.withColumn("members", F.pmod(F.xxhash64("account_id"), F.lit(GROUPS)).cast("int")).groupBy("members").transformWithStateInPandas(
        statefulProcessor=AccountState(burst_s, link_s, keep, buffer_s, limit), outputStructType=_ddl(OUT), outputMode="append", timeMode="None")
