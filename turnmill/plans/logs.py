"""Queries on logs. The tables hold facts, no logs, so facts are written as log lines and read back: the readers meet whole tables, and their SQL is that of the facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.operators import analyses as an
from turnmill.operators import query
from turnmill.plans.reference import define
from turnmill.sources import facts, jsonl
from turnmill.sources.tables import table

_USED = {"input_tokens": "recordStart % 5000", "cached_input_tokens": "nullif(recordStart % 100, 7)", "output_tokens": "(recordStart * 7) % 900", "reasoning_output_tokens": "nullif(recordStart % 50, 0)", "total_tokens": "recordStart % 5000 + (recordStart * 7) % 900"}


def _codex(spark: SparkSession, d: str) -> DataFrame:
    """(source, value): every event as a line of the first log format; token counts follow from the record's offset."""
    e = facts.events(spark, d)
    kind, c = F.col("kind"), F.col
    line = lambda t, **payload: F.to_json(F.struct(c("eventKey").alias("timestamp"), F.lit(t).alias("type"), F.struct(*(v.alias(k) for k, v in payload.items())).alias("payload")))
    used = F.struct(*(F.expr(x).alias(k) for k, x in _USED.items()))
    result = F.to_json(F.struct(c("output").alias("output"), F.struct(c("exitCode").alias("exit_code")).alias("metadata")))
    value = (
        F.when(kind == "visible-message", line("response_item", type=F.lit("message"), role=F.lit("user"), content=F.array(F.struct(F.lit("input_text").alias("type"), c("sessionKey").alias("text")))))
        .when(kind == "capability-invocation", line("response_item", type=F.lit("function_call"), name=c("capabilityName"), arguments=c("input"), call_id=c("correlation")))
        .when(kind == "capability-result", line("response_item", type=F.lit("function_call_output"), call_id=c("correlation"), output=result))
        .when(kind == "turn-lifecycle", line("event_msg", type=F.lit("task_complete"))).when(kind == "token-usage", line("event_msg", type=F.lit("token_count"), model=F.concat(F.lit("m"), F.pmod("recordStart", F.lit(3)).cast("string")), info=F.struct(used.alias("last_token_usage"))))
        .otherwise(F.lit("no json"))
    )
    return e.select(F.col("sessionKey").alias("source"), value.alias("value"))


@define("s_log_events", "ev", """SELECT kind, capabilityName AS capability, CASE WHEN kind = 'capability-result' THEN CASE WHEN exitCode = 0 THEN 'completed' WHEN exitCode IS NOT NULL THEN 'failed' ELSE 'unknown' END END AS state, CASE WHEN kind = 'turn-lifecycle' THEN 'completed' END AS lifecycle,
count(*) AS n, count(correlation) AS correlated, count(input) AS inputs FROM (SELECT * REPLACE (CASE WHEN kind = 'capability-invocation' THEN capabilityName END AS capabilityName) FROM ev) GROUP BY 1, 2, 3, 4""")
def s_log_events(spark: SparkSession, d: str) -> DataFrame:
    return jsonl.codex_events(_codex(spark, d)).groupBy("kind", "capability", "state", "lifecycle").agg(F.count(F.lit(1)).alias("n"), F.count("correlation").alias("correlated"), F.count("input").alias("inputs"))


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    s = facts.sessions(spark, d).select("sessionKey", "provider", "projectKey")
    t = jsonl.token_usage(jsonl.codex_events(_codex(spark, d))).withColumnRenamed("source", "sessionKey").withColumnRenamed("at", "eventKey")
    return t.join(s, "sessionKey").withColumns({"turnKey": F.lit(None).cast("string"), "observedAt": F.lit(None).cast("bigint")})


_TOKENS = """, tk AS (SELECT ev.eventKey, ev.sessionKey, se.provider, se.projectKey, 'm' || (recordStart % 3) AS model, recordStart % 5000 AS input, nullif(recordStart % 100, 7) AS "cachedInput", NULL::BIGINT AS "cacheWriteInput", (recordStart * 7) % 900 AS output, nullif(recordStart % 50, 0) AS reasoning,
recordStart % 5000 + (recordStart * 7) % 900 AS total FROM ev JOIN se USING (sessionKey) WHERE kind = 'token-usage')"""
_METRICS = ", ".join(f'CASE WHEN count("{m}") = count(*) THEN sum("{m}")::BIGINT END AS "{m}Total", count("{m}") AS "{m}Present"' for m in jsonl.TOKENS)


@define("r_token_hotspots", "ev se", _TOKENS + f' SELECT provider, model, projectKey, count(*) AS events, {_METRICS}, min(eventKey) AS "firstEventKey" FROM tk GROUP BY 1, 2, 3')
def r_token_hotspots(spark: SparkSession, d: str) -> DataFrame:
    return an.token_hotspots(_tokens(spark, d), jsonl.TOKENS)


@define("agg_tokens", "ev se", _TOKENS + ' SELECT model AS token_model, provider, count(*) AS n, coalesce(sum(reasoning), 0)::DECIMAL(38,0) AS reasoning, max(total) AS most FROM tk GROUP BY 1, 2')
def agg_tokens(spark: SparkSession, d: str) -> DataFrame:
    """The token-usage resource through the planner."""
    metrics = [{"name": "n", "op": "count"}, {"name": "reasoning", "op": "sum", "field": "token.reasoning"}, {"name": "most", "op": "max", "field": "token.total"}]
    return query.aggregate(_tokens(spark, d), {"resource": "token-usage", "shape": {"kind": "aggregate", "groupBy": ["token.model", "provider"], "metrics": metrics}})


@define("q_records_token", "ev se", _TOKENS + ' SELECT eventKey, model AS token_model, output AS token_output FROM tk WHERE model = \'m1\' ORDER BY eventKey LIMIT 50')
def q_records_token(spark: SparkSession, d: str) -> DataFrame:
    where = {"field": "token.model", "op": "eq", "value": "m1"}
    return query.records(_tokens(spark, d), {"resource": "token-usage", "where": where, "shape": {"kind": "records", "fields": ["eventKey", "token.model", "token.output"]}})


def _spoken(spark: SparkSession, d: str) -> DataFrame:
    role = F.lower(F.trim("speaker_role"))
    rows = table(spark, d, "session_messages").where((F.lower(F.trim("entry_kind")) == "message") & role.isin("user", "assistant") & F.col("markdown").isNotNull() & F.col("session_key").isNotNull() & F.col("seq_no").isNotNull())
    return rows.groupBy("session_key", "seq_no").agg(F.min(F.struct(role.alias("role"), "markdown")).alias("m")).select("session_key", "seq_no", "m.role", "m.markdown")


def _claude(spark: SparkSession, d: str) -> DataFrame:
    """(source, value): messages as lines of the second log format; the number of an entry stands for its time."""
    m = _spoken(spark, d)
    return m.select(F.col("session_key").alias("source"), F.to_json(F.struct(F.col("role").alias("type"), F.lpad(F.col("seq_no").cast("string"), 9, "0").alias("timestamp"), F.struct("role", F.col("markdown").alias("content")).alias("message"))).alias("value"))


_SPOKEN = """WITH m AS (SELECT session_key, seq_no, min((r, markdown))[1] AS role, min((r, markdown))[2] AS markdown FROM (SELECT *, lower(trim(speaker_role)) AS r FROM session_messages WHERE lower(trim(entry_kind)) = 'message' AND markdown IS NOT NULL AND session_key IS NOT NULL AND seq_no IS NOT NULL) WHERE r IN ('user', 'assistant') GROUP BY 1, 2),
t AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_key ORDER BY seq_no)::BIGINT AS turn_no FROM m),
lt AS (SELECT session_key, turn_no, arg_min(markdown, seq_no) FILTER (role = 'user') AS problem, arg_max(markdown, seq_no) FILTER (role = 'assistant') AS "finalAnswer", count(*) AS messages FROM t WHERE turn_no > 0 GROUP BY 1, 2)
"""


@define("s_log_turns", "", _SPOKEN + 'SELECT session_key AS source, turn_no, problem, "finalAnswer", messages, CASE WHEN turn_no < max(turn_no) OVER (PARTITION BY session_key) THEN 1 ELSE 0 END AS closed FROM lt')
def s_log_turns(spark: SparkSession, d: str) -> DataFrame:
    return jsonl.log_turns(jsonl.claude_events(_claude(spark, d)), ["at"]).drop("terminal")


@define("s_log_deltas", "", _SPOKEN + 'SELECT session_key, turn_no AS upsert_no, 1::BIGINT AS expected_generation, 2::BIGINT AS generation, problem FROM lt WHERE turn_no >= 3 AND session_key IN (SELECT session_key FROM lt WHERE turn_no < 3)')
def s_log_deltas(spark: SparkSession, d: str) -> DataFrame:
    """What a second read of the logs adds, of which the first had two turns."""
    turns = jsonl.log_turns(jsonl.claude_events(_claude(spark, d)), ["at"])
    held = jsonl.log_delta(turns.where("turn_no < 3")).select(F.col("session_key").alias("source"), "turn_key", "revision", "generation")
    return jsonl.log_delta(turns, held).select("session_key", "upsert_no", "expected_generation", "generation", "problem")


@define("s_log_feed", "", _SPOKEN + 'SELECT session_key, turn_no AS upsert_no, problem FROM lt')
def s_log_feed(spark: SparkSession, d: str) -> DataFrame:
    """From logs to held turns: two reads give two deltas a session, and the change feed operator applies them."""
    from turnmill.operators import changefeed

    turns = jsonl.log_turns(jsonl.claude_events(_claude(spark, d)), ["at"])
    first = jsonl.log_delta(turns.where("turn_no < 3"))
    held = first.select(F.col("session_key").alias("source"), "turn_key", "revision", "generation")
    rows = first.unionByName(jsonl.log_delta(turns, held))
    text = lambda c: F.col(c).cast("string").alias(c)
    commits = rows.select("session_key", text("generation"), text("expected_generation"), "delta_id", F.lit("append").alias("delta_mode"), F.array().cast("array<string>").alias("turn_keys"), F.timestamp_micros("generation").alias("received_at")).distinct()
    applied = changefeed.held_turns(commits, rows.select("session_key", "delta_id", "upsert_no", "turn_key", "revision"))
    return applied.join(rows.select("session_key", "turn_key", "revision", "upsert_no", "problem"), ["session_key", "turn_key", "revision"]).select("session_key", "upsert_no", "problem")
