"""The fact model: one canonical DataFrame per resource, from the tables of a data folder.

Every table drops repeated deliveries of a record. Columns of a resource keep the names of its registry entry with
dots as underscores; projection pruning and filter pushdown work through all of them, since they are plain selects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.sources.tables import table

# File names by suffix.
DOC_SUFFIX, CODE_SUFFIX = r"\.(md|txt|rst)$", r"\.(rs|js|mjs|ts|py)$"
_PATH = r"((?:src|lib|tests|docs|tools|crates|config)/[A-Za-z0-9_./-]+)"


def newest(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """One row per key: the greatest by `by`, then by all other columns, so that ties have one answer. Map-side combined."""
    rest = [c for c in df.columns if c not in keys]
    order = [*by, *(c for c in rest if c not in by)]
    return df.groupBy(*keys).agg(F.max(F.struct(*order)).alias("_v")).select(*keys, *(F.col(f"_v.{c}").alias(c) for c in rest))


def micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "sessions").where("session_key is not null").select(
        F.col("session_key").alias("sessionKey"), "provider", F.col("project_key").alias("projectKey"), F.col("session_scope").alias("originScope"), "eligibility",
        micros("observed_start").alias("startedAt"), micros("observed_end").alias("endedAt"), F.col("duplicate_group_key").alias("groupKey"),
        F.col("dedupe_fingerprint").alias("fingerprint"), F.col("duplicate_method").alias("method"), F.col("duplicate_confidence").alias("confidence"), F.col("originator_version").alias("version"),
    )
    return newest(rows, ["sessionKey"], ["endedAt", "startedAt"])


def turns(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "turn_upserts").where("turn_key is not null").select(
        F.col("turn_key").alias("turnKey"), F.col("session_key").alias("sessionKey"), micros("observed_timestamp").alias("observedAt"), "revision",
        F.col("turn_start_offset").alias("startOffset"), F.col("problem_text").alias("problem"), F.col("final_answer_excerpt").alias("finalAnswer"),
        F.col("provider_terminal").alias("terminal"), F.col("provider_visibility").alias("visibility"),
    )
    return newest(rows, ["turnKey"], ["observedAt", "revision"])


def events(spark: SparkSession, folder: str, where: Column | str | None = None) -> DataFrame:
    """Deliveries of an event differ only in their arrival. A condition goes before the dedup, so that it reaches the scan, and
    dedup is by key alone, so that unused columns are never read."""
    rows = table(spark, folder, "history_events").where("event_key is not null").select(
        F.col("event_key").alias("eventKey"), F.col("session_key").alias("sessionKey"), F.col("turn_key").alias("turnKey"), F.col("project_key").alias("projectKey"), "provider",
        F.col("record_start_offset").alias("recordStart"), F.col("content_index").alias("contentIndex"), F.col("event_ordinal").alias("ordinal"), F.col("origin_scope").alias("originScope"),
        micros("observed_at").alias("observedAt"), F.col("event_kind").alias("kind"), "completeness", F.col("capability_key").alias("capabilityKey"), F.col("capability_name").alias("capabilityName"),
        F.col("correlation_digest").alias("correlation"), F.col("input_fingerprint").alias("inputFingerprint"), F.col("provider_state").alias("state"), F.col("exit_code").cast("bigint").alias("exitCode"),
        F.col("duration_ms").alias("durationMs"), F.col("input_text").alias("input"), F.col("output_text").alias("output"), F.col("error_text").alias("error"),
    )
    return (rows if where is None else rows.where(where)).dropDuplicates(["eventKey"])


def order(df_prefix: str = "") -> Column:
    """Source order of an event inside its session."""
    return F.struct(*(F.col(f"{df_prefix}{c}") for c in ("recordStart", "contentIndex", "ordinal", "eventKey")))


def outcome() -> Column:
    """What became of a result: failed and completed as recorded, else by exit code, else unknown."""
    return (
        F.when(F.col("state").isin("failed", "error"), "failed").when(F.col("state") == "completed", "completed").when(F.col("state") == "cancelled", "cancelled")
        .when(F.col("exitCode") == 0, "completed").when(F.col("exitCode").isNotNull(), "failed").otherwise("unknown")
    )


def capability_uses(spark: SparkSession, folder: str) -> DataFrame:
    """One row per invocation with the state of its result: the first result of the same correlation behind it, else pending.

    An ignore-nulls window instead of a self-join: one shuffle by (session, correlation). Invocations without a correlation can have no
    result and don't enter it."""
    from pyspark.sql import Window

    e = events(spark, folder, "kind in ('capability-invocation', 'capability-result')")
    lone = e.where("correlation is null and kind = 'capability-invocation'").withColumn("result", F.lit(None).cast("struct<state: string, at: bigint>"))
    e = e.where("correlation is not null")
    back = [F.col(c).desc() for c in ("recordStart", "contentIndex", "ordinal", "eventKey")]
    line = Window.partitionBy("sessionKey", "correlation").orderBy(*back).rowsBetween(Window.unboundedPreceding, -1)  # backwards, so that the frame only grows
    result = F.when(F.col("kind") == "capability-result", F.struct(outcome().alias("state"), F.col("observedAt").alias("at")))
    skill = F.col("capabilityName").startswith("skill:")
    return e.withColumn("result", F.last(result, ignorenulls=True).over(line)).where("kind = 'capability-invocation'").unionByName(lone).select(
        F.col("eventKey").alias("useKey"), "sessionKey", "turnKey", "projectKey", "provider", "originScope", "observedAt", "recordStart", "contentIndex", "ordinal", "capabilityKey", "capabilityName",
        "inputFingerprint", F.col("correlation").alias("correlationDigest"), F.coalesce("result.state", F.lit("pending")).alias("terminalState"), F.col("result.at").alias("resultAt"),
        F.when(skill, "skill").when(~skill, "tool").alias("capabilityKind"), F.sha2(F.concat_ws("\u0000", "sessionKey", "capabilityKey"), 256).alias("chainKey"),
    )


def file_activities(spark: SparkSession, folder: str) -> DataFrame:
    """One row per file named in an invocation's input."""
    e = events(spark, folder, "kind = 'capability-invocation' and input is not null")
    paths = e.select("*", F.posexplode(F.array_distinct(F.regexp_extract_all("input", F.lit(_PATH), 1))).alias("activityOrdinal", "path"))
    verb = F.lower(F.col("capabilityName"))
    action = (
        F.when(F.col("input").rlike(r"^\s*\*\*\* update|<<NOTE"), "edit").when(F.col("input").rlike(r"^\s*rg "), "search").when(verb.rlike("edit|write|patch"), "edit")
        .when(verb.rlike("search|query|grep|index"), "search").when(verb.rlike("list"), "list").otherwise("read")
    )
    return paths.select("eventKey", "activityOrdinal", "sessionKey", "turnKey", "projectKey", "provider", "observedAt", "path", action.alias("action"))


def file_facts(spark: SparkSession, folder: str) -> DataFrame:
    """file_activities with what became of the use (confirmed, failed, attempted or unknown) and how the path was named."""
    from turnmill.functions.text import normalize_path

    phase = F.when(F.col("terminalState") == "completed", "confirmed").when(F.col("terminalState") == "failed", "failed").when(F.col("terminalState") == "pending", "attempted").otherwise("unknown")
    uses = capability_uses(spark, folder).select(F.col("useKey").alias("eventKey"), phase.alias("phase"))
    absolute = F.col("rawPath").rlike(r"^([A-Za-z]:)?[\\/]")
    rows = file_activities(spark, folder).join(uses, "eventKey").withColumn("rawPath", F.col("path")).withColumn("path", normalize_path(F.col("path")))
    return rows.withColumns({"pathRole": F.lit("target"), "absolute": absolute.cast("int"), "projectRelative": (~absolute).cast("int"), "relativePath": F.when(~absolute, F.col("path"))})


def errors(spark: SparkSession, folder: str) -> DataFrame:
    from turnmill.functions.text import error_signature, nfc

    e = events(spark, folder, "error is not null")
    return e.select("eventKey", "sessionKey", "turnKey", "projectKey", "provider", "observedAt", "capabilityKey", "capabilityName", "exitCode", F.col("state").alias("providerState"), error_signature(nfc("error")).alias("signature"), F.col("error").alias("content"))


def delivery_edges(spark: SparkSession, folder: str) -> DataFrame:
    """One row per commit and listed parent."""
    c = table(spark, folder, "git_commits").select(
        F.col("repository_id").alias("repositoryKey"), F.lower("object_id").alias("fromKey"), F.posexplode(F.from_json(F.lower("parent_object_ids_json"), "array<string>")).alias("parentNo", "toKey"),
        micros("committer_timestamp").alias("observedAt"), F.col("reachable").cast("int").alias("reachable"),
    )
    kinds = {"fromKind": "commit", "toKind": "commit", "relation": "commit-parent", "strength": "direct", "source": "git-parents"}
    one = c.where("trim(toKey) != ''").groupBy("repositoryKey", "fromKey", "parentNo", "toKey", "observedAt").agg(F.max("reachable").alias("reachable"))
    return one.withColumns({k: F.lit(v) for k, v in kinds.items()} | {"edgeKey": F.sha2(F.concat_ws("\u0000", "repositoryKey", "fromKey", "toKey", F.col("parentNo").cast("string")), 256)})


RESOURCES = {
    "session": sessions, "turn": turns, "event": events, "capability-use": capability_uses, "file-activity": file_facts, "error-occurrence": errors, "delivery-edge": delivery_edges,
}


def source(resource: str, spark: SparkSession, folder: str):
    """What the query planner reads a resource through: a function of the predicate, which applies it as early as it can."""

    def read(where: Column | None) -> DataFrame:
        if resource == "event":
            return events(spark, folder, where)
        rows = RESOURCES[resource](spark, folder)
        return rows if where is None else rows.where(where)

    return read
