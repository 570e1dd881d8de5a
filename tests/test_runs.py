"""Keyed state over event files: any order of files, restarts, brute force."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from postmill.streaming import runs

START = datetime.datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp, user_id long, event_type string"
LOG = "user_id long, window timestamp, n_events long, status string, ended_at long"


def table(n=240, days=4):
    rng = random.Random(6)
    return [(i, START + datetime.timedelta(minutes=rng.randrange(days * 1440)), rng.randrange(4), rng.choice(["step", "step", "completed", "failed", "request", "approve"])) for i in range(n)]


def rows_of(spark, path):
    events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    return runs.windowed(events, "ts", "event_id", F.col("event_type"), [F.col("user_id")])


def expected(events):
    last = max(e[1] for e in events) - datetime.timedelta(days=5)
    days = {}
    for i, at, user, kind in events:
        days.setdefault((user, at.date()), []).append((at, i, kind))
    out = {}
    for (user, day), own in days.items():
        if datetime.datetime.combine(day, datetime.time()) + datetime.timedelta(days=1) <= last:
            ends = next((k for k, e in enumerate(sorted(own)) if e[2] in runs.TERMINAL), None)
            out[user, day] = (len(own), "running") if ends is None else (ends + 1, sorted(own)[ends][2])
    return out


@pytest.mark.parametrize("order", [1, 2])
def test_run_log_in_any_order_and_after_a_restart(spark, tmp_path, order):
    events = table() + [(999, START + datetime.timedelta(days=9), 0, "step")]  # the last one lets the watermark pass all days
    shuffled = events[:-1]
    random.Random(order).shuffle(shuffled)
    where = str(tmp_path / "in")
    put = lambda part: spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(where)
    query = lambda: runs.drain_state(runs.settled(rows_of(spark, where), ["user_id", "window"], "5 days", runs.run_log, LOG), str(tmp_path / "run"))
    put(shuffled[:120])
    query()  # ends, and goes on from its checkpoint
    put(shuffled[120:])
    put(events[-1:])
    got = {(r.user_id, r.window.date()): (r.n_events, r.status) for r in query().collect()}
    assert got == expected(events) and len(got) == 16 and any(s != "running" for _, s in got.values())


def test_approvals_of_one_key():
    hour = 3_600_000_000
    events = [(0, 1, "request"), (hour, 2, "request"), (2 * hour, 3, "approve"), (3 * hour, 4, "reject"), (4 * hour, 5, "request"), (30 * hour, 6, "approve"), (31 * hour, 7, "request"), (31 * hour, 8, "step"), (32 * hour, 9, "reject"), (33 * hour, 10, "request")]
    assert runs.approvals(events, 24) == (4, 1, 1, 1, 1, 1, 2)
    assert runs.approvals([], 24) == (0,) * 7


def test_an_event_is_heard_while_its_window_is_open(spark, tmp_path):
    hours = lambda *at: [(h, START + datetime.timedelta(hours=h), 1, "step") for h in at]
    where = str(tmp_path / "in")
    for part in (hours(12, 20), hours(13, 300)):  # 13 is behind the watermark of 19, its day is not
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(where)
        out = runs.drain_state(runs.settled(rows_of(spark, where), ["user_id", "window"], "1 hour", runs.run_log, LOG), str(tmp_path / "run"))
    assert [(r.window.day, r.n_events) for r in out.collect()] == [(1, 3)]
