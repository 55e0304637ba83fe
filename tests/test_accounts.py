"""The account state of many accounts at once, against what each event's past says when it is looked up row by row."""

import random
from statistics import stdev

import numpy as np
import pandas as pd
import pytest

from tracewell.streaming import accounts as A

HOUR = 3_600_000_000


class Held:
    """A list state in memory."""

    def __init__(self):
        self.rows = []

    def exists(self):
        return bool(self.rows)

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        assert all(isinstance(x, (str, int, float, type(None))) and x == x for row in rows for column in row for x in column)
        self.rows = list(rows)

    def clear(self):
        self.rows = []


class Handle:
    def getListState(self, name, schema):
        return Held()


def _batches():
    rng, at, out, n = random.Random(7), 0, [], 0
    for _ in range(5):
        rows = []
        for _ in range(120):
            at += rng.choice([0, 0, 60_000_000, 300_000_000, HOUR])
            n += 1
            who, row = f"ACC_{rng.randrange(6)}", dict.fromkeys([*A.EVENT, *A.ACCESS, *A.PAYMENT])
            if rng.random() < 0.4:
                row.update(kind="access", turn=str(n).zfill(20), a_event_id=str(n), a_account_id=who, a_timestamp=at, a_records_accessed=rng.choice([None, 3]))
            else:
                row.update(kind="transaction", turn=f"T{n:04d}", t_transaction_id=f"T{n:04d}", t_account_id=who, t_timestamp=at, t_amount=rng.choice([None, 49000.25, 30000.1, 60000.7, 1e9]),
                           t_transaction_type=rng.choice([None, "TRANSFER", "DEBIT"]), t_counterparty_id=rng.choice([None, "X", "Y", "Z"]))
            rows.append({**row, "account_id": who, "at": at})
        at += 1
        rng.shuffle(rows)
        out.append(rows)
    return out


def _expected(every, keep, burst, link):
    """By event: its past, looked up in all events before it."""
    every, out = sorted(every, key=lambda r: (r["at"], r["kind"], r["turn"])), {}
    for i, r in enumerate(every):
        mine = [x for x in every[:i] if x["account_id"] == r["account_id"]]
        near = [x for x in mine if x["kind"] != r["kind"] and x["at"] >= r["at"] - link and (r["kind"] == "transaction" or x["at"] < r["at"])]
        linked = near[0]["turn"] if near else None
        if r["kind"] == "access":
            out[r["turn"]] = (linked, None)
            continue
        paid = [x for x in mine if x["kind"] == "transaction"]
        amounts, pair = [x["t_amount"] for x in paid if x["t_amount"] is not None], [x for x in [*paid, r] if x["t_counterparty_id"] == r["t_counterparty_id"]]
        burst_ = [x["t_amount"] for x in [*paid, r][-keep:] if x["at"] >= r["at"] - burst and x["t_amount"] is not None and x["t_amount"] < 50000]
        out[r["turn"]] = (linked, [
            len(paid), sum(amounts) / len(amounts) if amounts else 0, stdev(amounts) if len(amounts) > 1 else 0, max(amounts, default=0), (r["at"] - (paid[0] if paid else r)["at"]) / HOUR,
            (r["at"] - paid[-1]["at"]) / 24 / HOUR if paid else 999, float(bool(paid) and paid[-1]["t_transaction_type"] is not None and paid[-1]["t_transaction_type"] == r["t_transaction_type"]),
            float(len(pair) == 1), len(burst_), sum(burst_), sum(x["t_amount"] or 0 for x in pair), pair[0]["at"]])
    return out


def test_a_group_of_accounts_is_gone_over_at_once(monkeypatch):
    monkeypatch.setattr(A, "CHUNK", 4)  # state in many entries
    state = A.AccountState(2 * 3600.0, 240.0, 4, 24 * 3600.0, 50000.0)
    state.init(Handle())
    batches = _batches()
    want, got = _expected([r for rows in batches for r in rows], 4, 2 * HOUR, 240_000_000), {}
    for rows in batches:
        table = pd.DataFrame(rows)
        parts = [table.iloc[:50], table.iloc[50:]]
        for r in pd.concat(state.handleInputRows(0, iter(parts), None)).to_dict("records"):
            shown = {c: None if pd.isna(v) else v for c, v in r.items()}
            assert shown["account_id"] == (shown["a_account_id"] or shown["account_id"]) == (shown["t_account_id"] or shown["account_id"])
            near = shown["t_transaction_id"] if shown["kind"] == "access" else shown["a_event_id"] and shown["a_event_id"].zfill(20)
            got[shown["turn"]] = (near, [shown[c] for c in A.PAST] if shown["kind"] == "transaction" else None)
    assert set(got) == set(want) and sum(v[0] is not None for v in want.values()) > 50
    for turn, (near, past) in want.items():
        assert got[turn][0] == near
        assert (got[turn][1] is None) == (past is None) and (past is None or got[turn][1] == pytest.approx(past, rel=1e-9, abs=1e-6))


def test_groups_with_one_kind_of_event_only():
    rows = [r for r in _batches()[0]]
    for kind in ("access", "transaction"):
        state = A.AccountState(2 * 3600.0, 240.0, 4, 24 * 3600.0, 50000.0)
        state.init(Handle())
        mine = [r for r in rows if r["kind"] == kind]
        table = pd.concat(state.handleInputRows(0, iter([pd.DataFrame(mine)]), None))
        assert len(table) == len(mine) and list(table.columns) == list(A.OUT)
        assert (np.array(table["cluster_count"].notna()) == (kind == "transaction")).all()


def test_tagged_lines_are_read_once_and_give_the_rows_of_both_kinds(spark, tmp_path):
    from tracewell import schemas
    from tracewell.streaming import runs

    pay = '{"transaction_id":"T1","account_id":"A","amount":49000.25,"counterparty_id":"X","timestamp":"2024-01-01T00:00:01.000002Z","is_fraud":1}'
    seen = '{"employee_id":"E","account_id":"A","timestamp":"2024-01-01T00:00:00.5Z","records_accessed":3}'
    lines = [("transactions", pay, "T1"), ("access_logs", seen, "7"), ("access_events", seen, None), (None, pay, "T1"), ("alerts", pay, "T1"),
             ("transactions", None, "T2"), ("transactions", "{broken", "T3"), ("access_events", "{broken", "8")]
    path = str(tmp_path / "lines")
    spark.createDataFrame(lines, "topic string, payload string, event_key string").write.json(path)
    table = spark.read.schema(schemas.EVENT_LINES).json(path)
    got, want = A.tagged_events(table), A.events(*runs.split_topics(table))
    assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in want.schema]
    key = lambda r: tuple(map(str, r))
    some = lambda rows: sorted((tuple(r) for r in rows.where("account_id is not null and at is not null").collect()), key=key)
    assert some(got) == some(want) and len(some(got)) == 4
    scans = lambda df: df._jdf.queryExecution().executedPlan().toString().count("FileScan json")
    assert (scans(got), scans(want)) == (1, 2)


def test_the_stream_of_alerts_reads_its_lines_once(spark, tmp_path, monkeypatch):
    from tracewell.streaming import detectors, runs

    seen = []
    monkeypatch.setattr(A, "account_stream", lambda events, *_: seen.append(events) or events)
    monkeypatch.setattr(runs, "replay", lambda *_, through: through(spark.createDataFrame([], "topic string, payload string, event_key string")))
    spark.range(1).write.parquet(str(tmp_path / "alerts"))
    detectors.stream_alerts(spark.range(0), spark.range(0), str(tmp_path))
    assert "Union" not in seen[0]._jdf.queryExecution().analyzed().toString()


def test_states_come_back_as_they_were_put():
    rows = A._typed(pd.DataFrame({"account_id": ["a", None, "c"], "at": pd.array([2**62 + 1, None, 3], "Int64"), "amount": [0.1, np.nan, 3.0]}), A.RECENT)
    state, whole = Held(), A._typed(pd.concat([rows] * 5000, ignore_index=True), A.RECENT)
    A._write(state, A.RECENT, whole)
    assert len(state.rows) == 2
    pd.testing.assert_frame_equal(A._read(state, A.RECENT), whole)
    left = rows[["account_id", "at"]]
    stacked = A._stacked([rows, left], A.RECENT)
    pd.testing.assert_frame_equal(stacked, A._typed(pd.concat([rows, left.assign(amount=np.nan)], ignore_index=True), A.RECENT))
