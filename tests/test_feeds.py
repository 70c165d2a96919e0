"""Log sources, versioned tables and streams: a restarted stream gives what one batch gives."""

import json

from pyspark.sql import functions as F

from turnmill.operators import changefeed
from turnmill.sources import jsonl
from turnmill.sources.versions import VersionedTable, json_pages
from turnmill.streaming import feeds


def test_codex_lines(spark, tmp_path):
    log = [
        {"timestamp": "t0", "type": "session_meta", "payload": {"id": "x"}}, {"timestamp": "t1", "type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "hi"}, {"type": "input_text", "text": "there"}]}},
        {"timestamp": "t2", "type": "response_item", "payload": {"type": "function_call", "name": "shell", "arguments": "{\"a\":1}", "call_id": "c1"}}, {"timestamp": "t3", "type": "response_item", "payload": {"type": "function_call_output", "call_id": "c1", "output": json.dumps({"output": "x", "metadata": {"exit_code": 1}})}},
        {"timestamp": "t4", "type": "event_msg", "payload": {"type": "task_complete"}}, {"timestamp": "t5", "type": "event_msg", "payload": {"type": "token_count"}},
    ]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.jsonl").write_text("\n".join(map(json.dumps, log)) + "\nnot json\n", encoding="utf-8")
    lines = jsonl.lines(spark, str(tmp_path))
    got = jsonl.codex_events(lines).collect()
    assert [r["kind"] for r in got] == ["provider-status", "visible-message", "capability-invocation", "capability-result", "turn-lifecycle", "token-usage", "provider-unknown"]
    assert got[1]["text"] == "hi\nthere" and got[2]["correlation"] == got[3]["correlation"] == "c1" and got[3]["state"] == "failed"
    starts = [r["line_start"] for r in lines.orderBy("line_start").collect()]
    raw = (tmp_path / "d" / "a.jsonl").read_bytes()
    assert starts == [0] + [i + 1 for i, b in enumerate(raw) if b == 10][:-1]


def test_claude_lines(spark):
    log = [
        {"type": "user", "timestamp": "t1", "message": {"role": "user", "content": "plain"}},
        {"type": "assistant", "timestamp": "t2", "message": {"role": "assistant", "content": [{"type": "text", "text": "ok"}, {"type": "tool_use", "id": "u1", "name": "Read", "input": {"p": 1}}]}},
        {"type": "user", "timestamp": "t3", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "u1", "content": "out", "is_error": True}]}}, {"type": "summary"},
    ]
    rows = spark.createDataFrame([("s", json.dumps(x)) for x in log], "source string, value string")
    got = jsonl.claude_events(rows).collect()
    assert [(r["kind"], r["text"], r["correlation"], r["state"]) for r in got] == [("visible-message", "plain", None, None), ("visible-message", "ok", None, None), ("capability-invocation", None, "u1", None), ("capability-result", None, "u1", "failed"), ("provider-unknown", None, None, None)]
    assert got[-1]["raw"] == json.dumps({"type": "summary"})
    used = {"type": "assistant", "timestamp": "t", "message": {"role": "assistant", "content": "[not json", "model": "m1", "usage": {"input_tokens": 5, "cache_read_input_tokens": 2, "output_tokens": 3}}}
    rows = spark.createDataFrame([("s", json.dumps(used))], "source string, value string")
    assert jsonl.claude_events(rows).where("kind = 'visible-message'").first()["text"] == "[not json"
    assert tuple(jsonl.token_usage(jsonl.claude_events(rows)).first()) == ("s", "t", "request", "m1", 5, 2, None, 3, None, 10)


def test_offsets_of_any_line_ends_and_resuming(spark, tmp_path):
    raw = b"one\r\ntwo\n\r\nfour \xc3\xbc\nfive"
    (tmp_path / "x.jsonl").write_bytes(raw)
    read = jsonl.lines(spark, str(tmp_path))
    got = sorted((r["line_start"], r["value"]) for r in read.collect())
    assert got == [(0, "one"), (5, "two"), (9, ""), (11, "four ü"), (19, "five")]
    assert all(raw[a : a + len(v.encode())] == v.encode() for a, v in got)
    done = spark.createDataFrame(jsonl.checkpoint(read).collect(), "source string, complete bigint")
    (tmp_path / "x.jsonl").write_bytes(raw + b"\nsix\n")
    assert [r["value"] for r in jsonl.lines(spark, str(tmp_path), after=done).collect()] == ["six"]
    assert {r["value"] for r in jsonl.lines(spark, str(tmp_path), record_bytes=4).collect()} == {"one", "two", "", None, "five", "six"}


def test_turns_and_deltas_of_logs(spark):
    say = lambda n, role, text: ("s", f"{n:03d}", "visible-message", role, text, None)
    rows = [say(0, "assistant", "early"), say(1, "user", "q1"), say(2, "assistant", "a"), say(3, "assistant", "b"), ("s", "004", "turn-lifecycle", None, None, "completed"), say(5, "user", "q2")]
    events = spark.createDataFrame(rows, "source string, at string, kind string, role string, text string, lifecycle string")
    turns = jsonl.log_turns(events, ["at"])
    assert sorted((r["turn_no"], r["problem"], r["finalAnswer"], r["terminal"], r["messages"], r["closed"]) for r in turns.collect()) == [(1, "q1", "b", "completed", 3, 1), (2, "q2", None, None, 1, 0)]
    first = jsonl.log_delta(turns)
    held = first.selectExpr("session_key as source", "turn_key", "revision", "generation")
    assert {(r["expected_generation"], r["generation"]) for r in first.collect()} == {(0, 1)} and jsonl.log_delta(turns, held).isEmpty()
    more = jsonl.log_turns(events.unionByName(spark.createDataFrame([say(6, "assistant", "c")], events.schema)), ["at"])
    again = jsonl.log_delta(more, held).collect()
    assert [(r["upsert_no"], r["finalAnswer"], r["expected_generation"], r["generation"]) for r in again] == [(2, "c", 1, 2)] and again[0]["delta_id"] != first.first()["delta_id"]


def test_checklists(spark):
    rows = spark.createDataFrame([("s", i, v) for i, v in enumerate(["# Plan", "- [x] first #12", "text", "## Next", "  * [ ] second"])], "source string, line_start bigint, value string")
    assert [(r["feature"], r["story"], r["done"], r["refs"]) for r in jsonl.checklist(rows).orderBy("line_start").collect()] == [("Plan", "first #12", 1, ["12"]), ("Next", "second", 0, [])]


def test_stream_equals_batch_and_survives_restart(spark, tmp_path):
    schema = "k string, seq int, op int, v string"
    data = [(f"k{i % 5}", i * 7 % 23, i % 4 != 0, f"v{i}") for i in range(40)]
    rows = [(k, s, int(o), v) for k, s, o, v in data]
    src, table = str(tmp_path / "in"), VersionedTable(spark, str(tmp_path / "state"), ["k"], 4)
    args = (["k"], ["seq"], ["v"], str(tmp_path / "ckpt"))
    assert table.read() is None
    for part in (rows[:15], rows[10:30], rows[25:]):  # overlapping deliveries, a restart between
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        feeds.fold_stream(spark.readStream.schema(schema).parquet(src), table, *args).awaitTermination()
    want = changefeed.fold(spark.createDataFrame(rows, schema), ["k"], ["seq"], ["v"])
    assert sorted(map(str, table.read().collect())) == sorted(map(str, want.collect()))
    assert table.version() == 2 and len(table.state()["writers"]) == 1
    (writer,) = table.state()["writers"]
    assert table.write(want, writer, 1) is False
    try:
        table.write(want, writer, 9)
        raise AssertionError
    except ValueError:
        pass
    # another stream over the same state: its batches count from 0 again, and nothing is lost
    feeds.fold_stream(spark.readStream.schema(schema).parquet(src), table, *args[:-1], str(tmp_path / "ckpt2")).awaitTermination()
    spark.createDataFrame([("new", 1, 1, "x")], schema).coalesce(1).write.mode("append").parquet(src)
    feeds.fold_stream(spark.readStream.schema(schema).parquet(src), table, *args[:-1], str(tmp_path / "ckpt2")).awaitTermination()
    want = changefeed.fold(spark.createDataFrame([*rows, ("new", 1, 1, "x")], schema), ["k"], ["seq"], ["v"])
    assert sorted(map(str, table.read().collect())) == sorted(map(str, want.collect())) and len(table.state()["writers"]) == 2
    assert len(list((tmp_path / "state" / "commits").glob("[0-9]*"))) == 2


def test_tumbling_weeks_begin_on_monday(spark):
    df = spark.createDataFrame([("2026-03-01 23:59:59",), ("2026-03-02 00:00:00",), (None,)], "t string").select(F.to_timestamp("t").alias("t"))
    got = feeds.tumbling(df, "t", "7 days", "1 day", "4 days").select(F.date_format("bucket_start", "yyyy-MM-dd").alias("d"), "n").collect()
    assert sorted(map(tuple, got)) == [("2026-02-23", 1), ("2026-03-02", 1)]


def test_rollback_replay(spark):
    rows = [("s", 1, "a", True, None), ("s", 2, "b", True, None), ("s", 3, "c", True, None), ("s", 4, None, False, 2), ("s", 5, "d", True, None), ("s", 6, None, False, 9), ("s", 7, "e", False, None), ("t", 1, "x", True, None)]
    df = spark.createDataFrame(rows, "s string, n int, turn string, sealed boolean, back int")
    got = {(r["s"], r["turn"]): r["state"] for r in feeds.rolled_back(df, "s", ["n"], "turn", "sealed", "back").collect()}
    assert got == {("s", "a"): "rolled-back", ("s", "b"): "rolled-back", ("s", "c"): "rolled-back", ("s", "d"): "rolled-back", ("s", "e"): "unresolved", ("t", "x"): "active"}
    assert feeds.rolled_back(df.limit(0), "s", ["n"], "turn", "sealed", "back").collect() == []


def test_change_log_and_pages(spark):
    log = spark.createDataFrame([("a", 1), ("a", 5), ("b", 2)], "o string, s int")
    assert sorted(map(tuple, feeds.change_log(log, "o", "s", 1).collect())) == [("a", 5), ("b", 2)]
    pages = json_pages(log, ["s"], 32).collect()
    assert [r["page_no"] for r in sorted(pages, key=lambda r: r["s"])] == [0, 1, 2] or len({r["page_no"] for r in pages}) >= 2
    many = spark.createDataFrame([(i, "x" * (i % 50)) for i in range(300)], "s bigint, t string")
    for chunks in (1, 5):
        rows = sorted(json_pages(many, ["s"], 200, chunks).collect(), key=lambda r: r["s"])
        numbers = [r["page_no"] for r in rows]
        sizes: dict[int, int] = {}
        for r in rows:
            sizes[r["page_no"]] = sizes.get(r["page_no"], 0) + len(r["line"]) + 1
        assert numbers == sorted(numbers) and set(numbers) == set(range(max(numbers) + 1)) and max(sizes.values()) <= 200


def test_turns_of_growing_logs(spark, tmp_path):
    """Logs come in pieces, with a restart after each; the last row of every turn is what the whole logs give."""
    schema = "source string, at timestamp, line_start bigint, kind string, role string, text string, lifecycle string"
    rows = []
    for s, script in {"a": "uaauaAua", "b": "auCaau", "c": "u"}.items():
        for i, x in enumerate(script):
            role, low = {"u": "user", "a": "assistant"}.get(x.lower()), x.isupper()
            rows.append((s, f"2026-01-01 00:{i:02d}:00", i * 10, "turn-lifecycle" if low else "visible-message", None if low else role, None if low else f"{s}{i}", "completed" if low else None))
    frame = lambda part: spark.createDataFrame(part, schema.replace("timestamp", "string")).withColumn("at", F.to_timestamp("at"))
    src, sink, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    late = [("z", "2026-01-02 00:00:00", 0, "provider-status", None, None, None)]
    for part in ([r for r in rows if r[2] < 30], [r for r in rows if 30 <= r[2] < 60], [r for r in rows if r[2] >= 60], late):
        frame(part).coalesce(1).write.mode("append").parquet(src)
        turns = feeds.assembled_turns(spark.readStream.schema(schema).parquet(src), 60_000, "1 hour")
        turns.writeStream.format("parquet").option("path", sink).option("checkpointLocation", ckpt).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = {}
    for r in spark.read.parquet(sink).collect():
        key = (r["source"], r["turn_no"])
        if key not in got or (r["closed"], r["messages"]) >= got[key][-2:][::-1]:
            got[key] = (r["problem"], r["finalAnswer"], r["terminal"], r["messages"], r["closed"])
    want = {(r["source"], r["turn_no"]): (r["problem"], r["finalAnswer"], r["terminal"], r["messages"], r["closed"]) for r in jsonl.log_turns(frame(rows), ["line_start"]).collect()}
    assert got == want and len(want) == 6
