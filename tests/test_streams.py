"""Arriving logs in one and in several micro-batches against the same jobs over the whole log."""

import datetime as dt
import random

import pandas as pd
import pytest

from placewise.operators import compliance
from placewise.streaming import contacts, delivery
from placewise.streaming import visits as arrivals

LOG = "id long, account_id long, channel string, attempted_at timestamp_ntz, outcome string, legal_notice boolean"


def _log(n=400):
    rng = random.Random(2)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        at = start + dt.timedelta(minutes=rng.randrange(60 * 24 * 50))
        # Account 1 holds most rows; some attempts share a time.
        account = 1 if rng.random() < 0.6 else rng.randrange(2, 9)
        at = rows[-1][3] if rows and rng.random() < 0.1 else at
        rows.append((i, account, "SMS", at, "COMPLAINT" if rng.random() < 0.05 else None if rng.random() < 0.1 else "REACHED", rng.random() < 0.1))
    return sorted(rows, key=lambda r: r[3])


def _cuts(rows, files):
    """Files of rows; rows of one time stay together, since within a batch only earlier times count."""
    edges = [len(rows) * k // files for k in range(files + 1)]
    for k in range(1, files):
        while edges[k] < len(rows) and rows[edges[k]][3] == rows[edges[k] - 1][3]:
            edges[k] += 1
    return [rows[a:b] for a, b in zip(edges, edges[1:])]


@pytest.mark.parametrize("files", [1, 5])
def test_contact_guard_equals_the_whole_log(spark, tmp_path, files):
    rows = _log()
    source = str(tmp_path / "in")
    schema = spark.createDataFrame([], LOG).schema
    columns = ["id", "attempts_today", "attempts_7d", "attempts_14d", "last_complaint", "allowed", "reason", "next_allowed_at"]
    for part in _cuts(rows, files):
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(source)
        # One run for each delivery: the state outlives the query.
        log = spark.readStream.schema(schema).parquet(source)
        contacts.run_guard(contacts.guarded(log), str(tmp_path / "out"), str(tmp_path / "state"))
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(columns).collect()}
    want = {tuple(r) for r in compliance.verdicts(spark.createDataFrame(rows, LOG)).select(columns).collect()}
    assert got == want and len(got) == len(rows)


class _State:
    """What the state function needs of a group's state."""

    hasTimedOut = False
    exists = False

    def update(self, value):
        self.get, self.exists = value, True

    def remove(self):
        self.exists = False

    def setTimeoutDuration(self, milliseconds):
        self.milliseconds = milliseconds


def test_state_keeps_recent_attempts_only():
    state, update = _State(), contacts.recent_attempts(330, 15)
    for k in range(100):
        frame = pd.DataFrame({"us": [k * contacts.DAY_US], "complaint": [k % 10 == 0]})
        (out,) = update((1,), iter([frame]), state)
        assert out["attempts_14d"].tolist() == [min(k, 14)] and len(state.get[0]) <= contacts.KEPT_DAYS + 1
    assert state.milliseconds == 15 * 86_400_000
    state.hasTimedOut = True
    assert list(update((1,), iter([]), state)) == [] and not state.exists


VISITS = "visit_id long, account_id long, agent_id string, checkin_ts timestamp_ntz, checkin_x double, checkin_y double, gps_accuracy_m double, dwell_s int"


def _deliveries(files):
    """Visits in time order over ``files`` files; some are delivered again at once, in a later file, or without an account."""
    start = dt.datetime(2024, 1, 1)
    rows = [(i, None if i % 17 == 0 else i % 5, f"A{i % 3}", start + dt.timedelta(minutes=3 * i), float(i), 1.0, -1.0 if i % 11 == 0 else 5.0, 30) for i in range(200)]
    parts = [rows[200 * k // files : 200 * (k + 1) // files] for k in range(files)]
    for k, part in enumerate(parts):
        part += part[::7]
        if k:
            part += parts[k - 1][::9]
    return rows, parts


@pytest.mark.parametrize("files", [1, 5])
def test_repeats_pass_once_and_rejected_visits_are_kept_apart(spark, tmp_path, files):
    rows, parts = _deliveries(files)
    source, schema = str(tmp_path / "in"), spark.createDataFrame([], VISITS).schema
    accounts = spark.createDataFrame([(k,) for k in range(4)], "account_id long")
    for part in parts:
        spark.createDataFrame(part, VISITS).coalesce(1).write.mode("append").parquet(source)
        stream = arrivals.drop_repeats(spark.readStream.schema(schema).parquet(source))
        arrivals.run_batches(stream, delivery.VisitSinks(str(tmp_path / "sinks"), accounts), str(tmp_path / "state"))
    accepted = [r.visit_id for r in spark.read.parquet(str(tmp_path / "sinks/accepted")).collect()]
    refused = {r.visit_id: r.rejected for r in spark.read.parquet(str(tmp_path / "sinks/quarantine")).collect()}
    wrong = {r[0]: "invalid_value" if r[1] is None or r[6] < 0 else "unknown_account" for r in rows if r[1] is None or r[6] < 0 or r[1] == 4}
    assert refused == wrong and sorted(accepted) == sorted({r[0] for r in rows} - set(wrong))


def test_queue_sinks_in_batches_and_replayed(spark, tmp_path):
    schema = "item long, retries int, attempted_at timestamp_ntz, http_status int, error string"
    at = dt.datetime(2024, 1, 1)
    rows = [(1, 0, at, 200, None), (2, 4, at, 500, None), (3, 4, at, None, "timeout"), (4, 9, at, None, None), (5, 3, at, 404, None), (6, 4, at, 299, None)]
    sinks = delivery.QueueSinks(str(tmp_path))
    for batch_id, part in ((0, rows[:3]), (1, rows[3:]), (1, rows[3:])):
        sinks(spark.createDataFrame(part, schema), batch_id)
    read = lambda name: {(r["item"], r.retries) for r in spark.read.parquet(f"{tmp_path}/{name}").collect()}
    assert (read("synced"), read("pending"), read("dead_letter")) == ({(1, 0), (6, 4)}, {(5, 4)}, {(2, 5), (3, 5), (4, 10)})
    assert {r["item"]: (r.last_error, r.failed_at) for r in spark.read.parquet(f"{tmp_path}/dead_letter").collect()} == {2: ("HTTP 500", at), 3: ("timeout", at), 4: ("Network error", at)}
