"""Session logs in JSON lines: two public agent log formats and checklist markdown, parsed with built-in functions.

Works the same on spark.read.text and spark.readStream.text, as long as no byte offsets are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of one record at most; longer ones keep their place and size, not their text.
RECORD_BYTES = 64 << 20
TOKENS = ("input", "cachedInput", "cacheWriteInput", "output", "reasoning", "total")
_TEXT = ["source", "at", "kind", "role", "text", "capability", "correlation", "input", "output", "state", "lifecycle", "model", "scope", "raw"]
_EVENT = [*_TEXT, *(f"tokens_{t}" for t in TOKENS)]


def lines(spark: SparkSession, folder: str, pattern: str = "*.jsonl", after: DataFrame | None = None, record_bytes: int = RECORD_BYTES) -> DataFrame:
    """(source, line_start, size, value) of every line of the files under a folder; line_start is its byte offset, size its bytes without the line feed. Discovery is recursive.

    Lines end with a line feed; a carriage return before it is counted but not part of the value. Records of more than record_bytes have no value. after: (source, complete) takes
    only what lies behind a byte offset that an earlier read was complete to. Sums of lengths run inside a split, and over the splits of a file from one row each."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("lineSep", "\n").text(folder)
    raw = raw.select("value", F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), F.octet_length("value").cast("bigint").alias("size"))
    inside = Window.partitionBy("source", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = raw.groupBy("source", "block").agg(F.sum(F.col("size") + 1).alias("s")).select("source", "block", F.coalesce(F.sum("s").over(over), F.lit(0)).alias("before"))
    placed = raw.withColumn("own", F.coalesce(F.sum(F.col("size") + 1).over(inside), F.lit(0))).join(blocks, ["source", "block"])
    out = placed.select("source", (F.col("own") + F.col("before")).alias("line_start"), "size", F.when(F.col("size") <= record_bytes, F.regexp_replace("value", "\r$", "")).alias("value"))
    if after is None:
        return out
    return out.join(after.select("source", F.col("complete").alias("_c")), "source", "left").where(F.col("_c").isNull() | (F.col("line_start") >= F.col("_c"))).drop("_c")


def checkpoint(read: DataFrame) -> DataFrame:
    """(source, complete): the offset behind the last line of each source, from lines(); the next read goes on there. A last line without line feed counts as complete."""
    return read.groupBy("source").agg(F.max(F.col("line_start") + F.col("size") + 1).alias("complete"))


def _event(**columns: Column) -> list[Column]:
    return [columns.get(c, F.lit(None)).cast("string").alias(c) for c in _TEXT] + [columns.get(f"tokens_{t}", F.lit(None)).cast("bigint").alias(f"tokens_{t}") for t in TOKENS]


def result_state(exit_code: Column, failed: Column) -> Column:
    """failed if so marked, else by exit code (0 completed), else unknown."""
    return F.when(failed, "failed").when(exit_code == 0, "completed").when(exit_code.isNotNull(), "failed").otherwise("unknown")


def codex_events(rows: DataFrame) -> DataFrame:
    """Events of logs whose lines are {timestamp, type, payload}. Lines that aren't JSON objects, and other types, become provider-unknown and keep their text in raw."""
    usage = "payload.info.last_token_usage"
    j = rows.select("source", F.col("value"), *(F.get_json_object("value", f"$.{p}").alias(a) for p, a in (
        ("timestamp", "at"), ("type", "t"), ("payload.type", "pt"), ("payload.role", "role"), ("payload.name", "name"), ("payload.call_id", "call"), ("payload.arguments", "args"), ("payload.output", "out"), ("payload.content[*].text", "texts"), ("payload.model", "model"),
        (f"{usage}.input_tokens", "k_input"), (f"{usage}.cached_input_tokens", "k_cachedInput"), (f"{usage}.output_tokens", "k_output"), (f"{usage}.reasoning_output_tokens", "k_reasoning"), (f"{usage}.total_tokens", "k_total"),
    )))
    item, told = F.col("t") == "response_item", F.col("t") == "event_msg"
    kind = (
        F.when(item & (F.col("pt") == "message"), "visible-message").when(item & F.col("pt").isin("function_call", "custom_tool_call", "local_shell_call"), "capability-invocation")
        .when(item & F.col("pt").isin("function_call_output", "custom_tool_call_output"), "capability-result").when(told & F.col("pt").isin("task_started", "task_complete", "turn_aborted"), "turn-lifecycle")
        .when(told & (F.col("pt") == "token_count"), "token-usage").when(F.col("t") == "session_meta", "provider-status").otherwise("provider-unknown")
    )
    many = F.from_json("texts", "array<string>")
    text = F.when(F.col("texts").startswith("[") & many.isNotNull(), F.array_join(many, "\n")).otherwise(F.regexp_replace("texts", r'^"|"$', ""))
    code = F.get_json_object("out", "$.metadata.exit_code").try_cast("int")
    state = F.when(kind == "capability-result", result_state(code, F.lit(False)))
    lifecycle = F.when(kind == "turn-lifecycle", F.when(F.col("pt") == "task_started", "started").when(F.col("pt") == "task_complete", "completed").otherwise("aborted"))
    tokens = {f"tokens_{t}": F.when(kind == "token-usage", F.col(f"k_{t}")) for t in TOKENS if t != "cacheWriteInput"}
    return j.select(*_event(
        source=F.col("source"), at=F.col("at"), kind=kind, role=F.col("role"), text=F.when(kind == "visible-message", text), capability=F.col("name"), correlation=F.col("call"), input=F.col("args"), output=F.col("out"), state=state,
        lifecycle=lifecycle, model=F.col("model"), scope=F.when(kind == "token-usage", "request"), raw=F.when(kind == "provider-unknown", F.col("value")), **tokens,
    ))


def claude_events(rows: DataFrame) -> DataFrame:
    """Events of logs whose lines are {type, timestamp, message: {role, content, model, usage}}; one event per content part, and one for the tokens of a message. Plain-text content is
    one message. Lines of other types, or that aren't JSON objects, become provider-unknown and keep their text in raw."""
    part = "struct<type: string, text: string, id: string, name: string, input: string, tool_use_id: string, content: string, is_error: boolean>"
    j = rows.select("source", "value", *(F.get_json_object("value", f"$.{p}").alias(a) for p, a in (
        ("timestamp", "at"), ("type", "t"), ("message.role", "role"), ("message.content", "content"), ("message.model", "model"), ("message.usage.input_tokens", "k_input"), ("message.usage.cache_read_input_tokens", "k_cachedInput"),
        ("message.usage.cache_creation_input_tokens", "k_cacheWriteInput"), ("message.usage.output_tokens", "k_output"),
    )))
    said = F.coalesce(F.col("t").isin("user", "assistant"), F.lit(False))
    parts = F.from_json("content", f"array<{part}>")
    plain = F.array(F.from_json(F.to_json(F.struct(F.lit("text").alias("type"), F.col("content").alias("text"))), part))
    one = lambda kind: F.array(F.from_json(F.to_json(F.struct(F.lit(kind).alias("type"))), part))
    used = F.coalesce("k_input", "k_output").isNotNull()
    held = F.when(said, F.concat(F.when(F.ltrim("content").startswith("["), F.coalesce(parts, plain)).otherwise(plain), F.when(used, one("tokens")).otherwise(F.array().cast(f"array<{part}>")))).otherwise(one("unknown"))
    rows = j.select("source", "value", "at", "role", "model", *(f"k_{t}" for t in TOKENS[:4]), F.explode(held).alias("p"))
    kind = F.when(F.col("p.type") == "tool_use", "capability-invocation").when(F.col("p.type") == "tool_result", "capability-result").when(F.col("p.type") == "text", "visible-message").when(F.col("p.type") == "tokens", "token-usage").otherwise("provider-unknown")
    state = F.when(kind == "capability-result", F.when(F.col("p.is_error"), "failed").when(F.col("p.is_error").isNotNull(), "completed").otherwise("unknown"))
    counted = {f"tokens_{t}": F.when(kind == "token-usage", F.col(f"k_{t}")) for t in TOKENS[:4]}
    total = sum((F.coalesce(F.col(f"k_{t}").cast("bigint"), F.lit(0)) for t in TOKENS[:4]), F.lit(0))
    return rows.select(*_event(
        source=F.col("source"), at=F.col("at"), kind=kind, role=F.col("role"), text=F.col("p.text"), capability=F.col("p.name"), correlation=F.coalesce("p.id", "p.tool_use_id"), input=F.col("p.input"), output=F.col("p.content"), state=state,
        model=F.when(kind == "token-usage", F.col("model")), scope=F.when(kind == "token-usage", "request"), raw=F.when(kind == "provider-unknown", F.col("value")), tokens_total=F.when(kind == "token-usage", total), **counted,
    ))


def token_usage(events: DataFrame) -> DataFrame:
    """(source, at, scope, model, input, cachedInput, cacheWriteInput, output, reasoning, total) of the token-usage events of a log."""
    return events.where("kind = 'token-usage'").select("source", "at", "scope", "model", *(F.col(f"tokens_{t}").alias(t) for t in TOKENS))


def log_turns(events: DataFrame, order: list[str]) -> DataFrame:
    """(source, turn_no, problem, finalAnswer, terminal, messages, closed) of the events of logs: a message of the user begins a turn, what follows belongs to it.

    finalAnswer is the assistant's last text, terminal the last lifecycle state but started; closed tells whether another turn follows. What comes before the first
    message of a user belongs to no turn. order are columns of events that give the order inside a source; logs are files, so a source is one window partition."""
    line = Window.partitionBy("source").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    said = F.col("kind") == "visible-message"
    rows = events.withColumn("turn_no", F.sum((said & (F.col("role") == "user")).cast("bigint")).over(line)).where("turn_no > 0")
    place = F.struct(*order)
    turns = rows.groupBy("source", "turn_no").agg(
        F.min_by("text", F.when(said & (F.col("role") == "user"), place)).alias("problem"), F.max_by("text", F.when(said & (F.col("role") == "assistant"), place)).alias("finalAnswer"),
        F.max_by("lifecycle", F.when(F.col("lifecycle").isin("completed", "aborted"), place)).alias("terminal"), F.count_if(said).alias("messages"),
    )
    return turns.withColumn("closed", (F.col("turn_no") < F.max("turn_no").over(Window.partitionBy("source"))).cast("int"))


def log_delta(turns: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """What a read of logs changes, as rows of a change feed: (session_key, delta_id, expected_generation, generation, turn_key, upsert_no, problem, finalAnswer, terminal).

    Only turns that are new, or differ from held (the same columns as turns), are in it; the generation goes on from that of held (source, generation), 0 without. Its id is a digest
    of what it holds, so the same read gives the same delta."""
    key = F.sha2(F.concat_ws("\u0000", "source", F.col("turn_no").cast("string")), 256)
    body = F.sha2(F.concat_ws("\u0000", *(F.coalesce(c, F.lit("\u0001")) for c in ("problem", "finalAnswer", "terminal"))), 256)
    rows = turns.select("source", "turn_no", "problem", "finalAnswer", "terminal", key.alias("turn_key"), body.alias("revision"))
    base = F.lit(0).cast("bigint").alias("_g")
    if held is not None:
        rows = rows.join(held.select("turn_key", "revision"), ["turn_key", "revision"], "left_anti").join(held.groupBy("source").agg(F.max("generation").alias("_g")), "source", "left").withColumn("_g", F.coalesce("_g", F.lit(0)))
    else:
        rows = rows.select("*", base)
    ids = rows.groupBy("source").agg(F.sha2(F.concat(F.count(F.lit(1)).cast("string"), F.bit_xor(F.xxhash64("turn_key", "revision")).cast("string"), F.max("revision")), 256).alias("delta_id"))
    return rows.join(ids, "source").select(F.col("source").alias("session_key"), "delta_id", F.col("_g").alias("expected_generation"), (F.col("_g") + 1).alias("generation"), "turn_key", F.col("turn_no").alias("upsert_no"), "revision", "problem", "finalAnswer", "terminal")


def checklist(rows: DataFrame) -> DataFrame:
    """(source, line_start, feature, feature_id, story, story_id, done, refs) of checklist markdown: list items as stories under the last heading, with the #-references in them.

    Ids are digests of the source and the title, and for a story of its feature too, so they stay the same when lines move."""
    line = Window.partitionBy("source").orderBy("line_start")
    heading = F.when(F.col("value").rlike(r"^#{1,6}\s+\S"), F.trim(F.regexp_replace("value", r"^#{1,6}\s+", "")))
    marked = rows.withColumn("feature", F.last(heading, ignorenulls=True).over(line))
    items = marked.where(F.col("value").rlike(r"^\s*[-*]\s+\[[ xX]\]\s+\S"))
    story = F.trim(F.regexp_replace("value", r"^\s*[-*]\s+\[[ xX]\]\s+", ""))
    digest = lambda *parts: F.sha2(F.concat_ws("\u0000", *parts), 256)
    return items.select(
        "source", "line_start", "feature", F.when(F.col("feature").isNotNull(), digest("source", "feature")).alias("feature_id"), story.alias("story"), digest("source", F.coalesce("feature", F.lit("")), story).alias("story_id"),
        F.col("value").rlike(r"^\s*[-*]\s+\[[xX]\]").cast("int").alias("done"), F.regexp_extract_all("value", F.lit(r"#([A-Za-z0-9-]+)"), 1).alias("refs"),
    )
