"""Streaming state against the rules, batch by batch and with small blocks."""

from datetime import datetime, timedelta

import pytest

from turnmill.llm import conversations as cv

S = "session_key string, entry_id string, seq_no int, created_at timestamp, received_at timestamp, entry_kind string, speaker_role string, markdown string, block string"
T0 = datetime(2026, 1, 1)


def talk(session, *entries):
    return [(session, f"{session}{i}", i, T0, T0 + timedelta(minutes=i), kind, role, text, "x") for i, (kind, role, text) in enumerate(entries)]


U, A, SYS, TOOL = ("message", " Human", "hi"), ("message", "AI", "yes"), ("message", "system", "be good"), ("tool", None, None)
GOOD = talk("good", SYS, U, TOOL, A, U, A, ("message", "user", " ​"), A)
ROWS = [
    *GOOD, *GOOD[::-1], *talk("late", U, A, U, A)[::-1], *talk("noanswer", U, A, U), *talk("twousers", U, U, A), *talk("starts", A, U, A), *talk("role", U, ("message", "??", "x"), A), *talk("blankrole", U, A, ("message", None, "")),
    *talk("nouser", SYS, A), *talk("void", TOOL), *talk("hole", U, A, U, A)[:1], *[r for r in talk("gap", U, A, U, A) if r[2] != 1], *talk("rival", U, A), ("rival", "other", 1, T0, T0, "message", "assistant", "no", "x"),
    ("nullseq", "n", None, T0, None, "message", "user", "x", "x"), (None, "n", 0, T0, T0, "message", "user", "x", "x"), *talk("long", *[U, A] * 9),
]
WANT = {("good", i + 1, f"good{n}") for i, n in enumerate([0, 1, 3, 4, 5, 7])} | {("late", n + 1, f"late{n}") for n in range(4)} | {("long", n + 1, f"long{n}") for n in range(18)}


@pytest.mark.parametrize(("block", "files", "idle"), [(1024, None, cv.IDLE_MS), (4, 1, cv.IDLE_MS), (1024, 1, 1), (4, 1, 1)])
def test_conversations(spark, tmp_path, monkeypatch, block, files, idle):
    monkeypatch.setattr(cv, "BLOCK", block)
    path = str(tmp_path / "messages.parquet")
    spark.createDataFrame(ROWS, S).repartition(3).write.parquet(path)
    got = cv.conversations(cv.blocks(spark, path, files, idle_ms=idle)).collect()
    assert {(r["session_key"], r["msg_index"], r["entry_id"]) for r in got} == WANT
    assert len(got) == len(WANT)


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "messages.parquet")
    spark.createDataFrame([], S).write.parquet(path)
    assert cv.conversations(cv.blocks(spark, path)).collect() == []


def test_released():
    got = cv.released(0, {"1": [["b", "a"]], "0": [["a", "u"]], "2": [["c", "s-"]]})
    assert [m["entry_id"] for m in got["messages"]] == ["a", "b"] and (got["entries"], got["low"], got["high"], got["broken"], got["unanswered"]) == (3, 0, 2, False, False)
    assert cv.released(0, {"0": [["a", "u"], ["b", "u"]]})["broken"] and cv.released(-1, {"-1": [["a", "u"]]})["broken"]


def test_missing_entry_ids_and_an_empty_session_key_are_kept(spark, tmp_path):
    from turnmill.llm import queries

    rows = talk("", U, A) + [(s, None if n == 1 else e, n, *x) for s, e, n, *x in talk("null", U, A, U, A)]
    spark.createDataFrame(rows, S).repartition(2).write.parquet(str(tmp_path / "session_messages.parquet"))
    want = {("", 1, "0"), ("", 2, "1"), ("null", 1, "null0"), ("null", 2, ""), ("null", 3, "null2"), ("null", 4, "null3")}
    for query in (queries.p5_found, queries.p5_conversations):
        got = query(spark, str(tmp_path)).collect()
        assert {(r["session_key"], r["msg_index"], r["entry_id"]) for r in got} == want and len(got) == len(want)
    assert all(r["markdown"] in ("hi", "yes") for r in got)


def test_conversations_close_in_the_course_of_a_replay(spark, tmp_path):
    """With a short wait a conversation is emitted before the feed ends, and what comes later makes a second piece."""
    path = str(tmp_path / "messages.parquet")
    one, two = talk("one", U, A), talk("two", U, A, U, A)
    two[3] = (*two[3][:4], T0 + timedelta(days=9), *two[3][5:])
    rest = [(f"s{k}", "e", 0, T0, T0 + timedelta(days=k), "tool", None, None, "x") for k in range(12)]
    spark.createDataFrame([*one, *two, *rest], S).write.parquet(path)
    pieces = cv.blocks(spark, path, 1, idle_ms=60_000)
    got = {(r["session_key"], tuple(r["seq_nos"]), r["whole"]) for r in pieces.where("session_key in ('one', 'two')").collect()}
    assert got == {("one", (0, 1), True), ("two", (0, 1, 2), False), ("two", (3,), False)}
    assert [(r["session_key"], r["entry_id"]) for r in cv.conversations(pieces).orderBy("session_key", "msg_index").collect()] == [("one", "one0"), ("one", "one1"), *[("two", f"two{n}") for n in range(4)]]


def test_rows_behind_the_watermark_are_an_error(spark, tmp_path):
    entries = lambda day: cv.entries(spark.createDataFrame([(f"s{day}", "e", 0, T0, T0 + timedelta(days=day), "message", "user", "x", "x")], S))
    feed, sink, state = (str(tmp_path / x) for x in ("feed", "sink", "state"))
    run = lambda: cv.stream_blocks(spark.readStream.schema(cv._ENTRY).parquet(feed), sink, state, "1 day", buckets=4)
    with cv._settings(spark, cv._STATE):
        entries(30).write.mode("append").parquet(feed)
        cv.ended(run())
        entries(1).write.mode("append").parquet(feed)
        with pytest.raises(ValueError, match="1 rows were later"):
            cv.ended(run())


def test_state_holds_two_ids_a_number_at_most():
    own = []
    for entry, code in [("c", "u"), ("a", "u"), ("b", "a"), ("a", "a"), ("z", "u")]:
        cv._keep(own, entry, code)
    assert sorted(own) == [["a", "a"], ["b", "a"]]
