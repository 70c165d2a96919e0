"""Runs against brute force; every chunking gives the same rows."""

import random
import re
from datetime import datetime, timedelta

import pytest

from turnmill.llm import runs

S = "event_key string, session_key string, record_start_offset bigint, content_index int, event_ordinal int, event_kind string, capability_key string, input_fingerprint string, input_text string, observed_at timestamp, ingested_at timestamp, chunk int, edge string"
T0 = datetime(2026, 1, 1)


def row(key, session, at, capability="c", print_=None, text=None, kind="capability-invocation"):
    return (key, session, at, 0, 0, kind, capability, print_, text, T0 + timedelta(seconds=at or 0), T0, 1, "x")


def brute(rows):
    out = set()
    by = {}
    for r in {r[0]: r for r in rows if r[5] == "capability-invocation" and r[0] and r[1]}.values():
        by.setdefault(r[1], []).append(r)
    plain = lambda t: None if t is None else re.sub(r"\s", "", re.sub(r"attempt \d+", "attempt", t))
    for s, events in by.items():
        events.sort(key=lambda r: (r[2] is not None, r[2] or 0, r[3], r[4], r[0]))
        run = [events[0]]
        for a, b in zip(events, events[1:] + [None], strict=True):
            if b is not None and a[6] is not None and a[6] == b[6] and (a[7] is not None and a[7] == b[7] or a[8] is not None and plain(a[8]) == plain(b[8])):
                run.append(b)
                continue
            if len(run) > 1:
                out.add((s, run[0][0], run[-1][0], len(run)))
            run = [b]
    return out


def found(spark, rows, chunk):
    return {(r["session_key"], r["first_event_key"], r["last_event_key"], r["run_length"]) for r in runs.runs(spark.createDataFrame(rows, S), chunk).collect()}


@pytest.mark.parametrize("chunk", [3, 10_000])
def test_random_sessions(spark, chunk):
    r = random.Random(chunk)
    rows = []
    for i in range(160):
        s = r.choice(["hot", "hot", "hot", "a", "b"])
        rows += [row(f"e{i:03d}", s, r.choice([i, i, i, None]) if s == "b" else i, r.choice(["c", "c", "c", "d", None]), r.choice(["f", "f", "g", None]), r.choice(["run x", " run  x\n", "run y # attempt 1", "run y # attempt 2", None, ""]))] * r.choice([1, 1, 2])
    rows += [row("m", "a", 5, kind="visible-message"), row(None, "a", 1), row("n", None, 1)]
    r.shuffle(rows)
    assert found(spark, rows, chunk) == brute(rows)


def test_one_run_over_many_chunks(spark):
    rows = [row(f"e{i:03d}", "s", i, print_="f") for i in range(90)]
    got = runs.runs(spark.createDataFrame(rows, S), 5).collect()
    assert [(r["first_event_key"], r["last_event_key"], r["run_length"], r["duration_ms"]) for r in got] == [("e000", "e089", 90, 89_000)]


def test_volatile_values(spark):
    from pyspark.sql import functions as F

    same = [
        ("a --since 2026-05-27T11:24:46Z", "a --since 2026-06-01T01:00:00Z"), ("a --stamp=1784686900175", "a --stamp=1784686900999"), ("a --parent-pid 123", "a --parent-pid 9"), ("a > /tmp/lane-x1.log", "a > /tmp/lane-y2.log"),
        ("a 8072aa84-41ce-4e1e-ae1e-fe8672385578", "a 1072aa84-41ce-4e1e-ae1e-fe8672385578"), ('{"requestId":"req-a1b2c3d4"}', '{"requestId":"req-ffffffff"}'), ("a # attempt 1", "a #  attempt 12"), ("a  b", " a\nb\t"),
    ]
    other = [('{"lines":"1-200"}', '{"lines":"201-400"}'), ("probe limit 4", "probe limit 5"), ("open a.rs", "open b.rs"), ("call 13125550105", "call 13125550106")]
    df = spark.createDataFrame([(x, y, 1) for x, y in same] + [(x, y, 0) for x, y in other], "x string, y string, same int")
    assert df.where((runs.settled(F.col("x")) == runs.settled(F.col("y"))).cast("int") != F.col("same")).collect() == []


def test_empty(spark):
    assert found(spark, [], 10) == set()
