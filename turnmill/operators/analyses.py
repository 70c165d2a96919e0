"""Named analyses over the fact model. Each is a DataFrame plan with one shuffle per grouping; nothing is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnmill.operators import windows

DAY_US = 86_400_000_000
SOURCE = ["recordStart", "contentIndex", "ordinal"]
STATES = ("completed", "failed", "cancelled", "unknown", "pending")


def day(us: str) -> Column:
    return F.floor(F.col(us) / DAY_US).cast("bigint")


def week(us: str) -> Column:
    """Number of the week, which begins on Monday."""
    return F.floor((day(us) + 3) / 7).cast("bigint")


def capability_contexts(uses: DataFrame, sessions: DataFrame) -> DataFrame:
    """Per capability: uses by state, distinct turns, sessions and duplicate groups, grouped and ungrouped sessions, strong and weak members, last use."""
    s = sessions.select("sessionKey", "groupKey", "confidence")
    one = uses.join(s, "sessionKey", "left")
    solo = F.when(F.col("groupKey").isNull(), F.col("sessionKey"))
    return one.groupBy("capabilityKey").agg(
        F.max("capabilityName").alias("capabilityName"), F.count(F.lit(1)).alias("invocations"), *(F.count_if(F.col("terminalState") == x).alias(x) for x in STATES), F.count_distinct("turnKey").alias("turns"),
        F.count_distinct("sessionKey").alias("sessions"), F.count_distinct("groupKey").alias("groups"), F.count_distinct(solo).alias("ungrouped"),
        F.count_distinct(F.when(F.col("confidence") == "strong", F.col("sessionKey"))).alias("strong"), F.count_distinct(F.when(F.col("confidence") == "weak", F.col("sessionKey"))).alias("weak"), F.max("observedAt").alias("lastUsedAt"),
    )


def top_projects(uses: DataFrame, k: int = 5) -> DataFrame:
    counts = uses.where("projectKey is not null").groupBy("capabilityKey", "projectKey").agg(F.count(F.lit(1)).alias("uses"), F.max("observedAt").alias("lastAt"))
    return windows.top_k(counts, ["capabilityKey"], [F.desc("uses"), F.col("lastAt").desc_nulls_last(), F.asc("projectKey")], k)


def failure_chains(uses: DataFrame) -> DataFrame:
    """Per session and capability: how its attempts ended. unknown if an attempt's end isn't known, resolved if the last completion is behind the first
    failure, never-succeeded if failures stay, abandoned without failure and completion; clean chains are left out."""
    at = F.struct(*SOURCE, "useKey")
    when = lambda state, agg: agg(F.when(F.col("terminalState") == state, at))
    c = uses.groupBy("sessionKey", "capabilityKey").agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("terminalState") == "failed").alias("failed"), F.count_if(F.col("terminalState") == "completed").alias("completed"),
        F.bool_or(F.col("terminalState").isin("unknown", "pending")).alias("_open"), when("failed", F.min).alias("_fail"), when("completed", F.max).alias("_done"), F.min("observedAt").alias("firstAt"), F.max("observedAt").alias("lastAt"),
    )
    status = F.when(F.col("_open"), "unknown").when(F.col("_done") > F.col("_fail"), "resolved").when(F.col("failed") > 0, "never-succeeded").when(F.col("completed") == 0, "abandoned").otherwise("clean")
    return c.withColumn("status", status).where("status != 'clean'").drop("_open", "_fail", "_done")


def file_workflow(files: DataFrame) -> DataFrame:
    """Per session: file activities by action, and what their proportions say."""
    lower = F.lower("path")
    c = files.groupBy("sessionKey").agg(
        F.count_if(F.col("action").isin("read", "search", "list")).alias("reads"), F.count_if(F.col("action").isin("edit", "write", "delete", "move")).alias("mutations"),
        F.count_if(lower.rlike(r"\.(md|txt|rst)$")).alias("docs"), F.count_if(lower.rlike(r"\.(rs|js|mjs|ts|py)$")).alias("code"), F.count_distinct("path").alias("paths"),
    )
    research = F.col("reads") >= 3 * F.greatest("mutations", F.lit(1))
    building = (F.col("mutations") >= 5) & (10 * F.col("reads") <= 8 * F.col("mutations"))
    flag = lambda x: x.cast("int")
    return c.select("*", flag(research).alias("researchHeavy"), flag(building).alias("implementationHeavy"), flag(research & (F.col("docs") == 0)).alias("docVoid"), flag(building & (F.col("docs") == 0)).alias("specPrecisionGap"))


def activity(events: DataFrame, bucket: Column) -> DataFrame:
    """Per bucket, empty ones included: events, sessions, turns, projects and uses."""
    rows = events.where("observedAt is not null").withColumn("bucket", bucket)
    counts = rows.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("sessionKey").alias("sessions"), F.count_distinct("turnKey").alias("turns"), F.count_distinct("projectKey").alias("projects"), F.count_if(F.col("kind") == "capability-invocation").alias("uses"),
    )
    calendar = rows.agg(F.min("bucket").alias("a"), F.max("bucket").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("bucket"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("events", "sessions", "turns", "projects", "uses")]
    return calendar.join(counts, "bucket", "left").select("bucket", *zero)


def with_change(buckets: DataFrame, value: str, lag: int = 1) -> DataFrame:
    """Adds the value of the bucket `lag` before, and the change to it; joined by index, so no global sort."""
    before = buckets.select((F.col("bucket") + lag).alias("bucket"), F.col(value).alias("baseline"))
    return buckets.join(before, "bucket", "left").withColumn("change", F.col(value) - F.col("baseline"))


def hotspots(events: DataFrame) -> DataFrame:
    """Per provider, capability and project: totals that are given only if every event has the metric, with their coverage."""
    whole = lambda c: F.when(F.count(c) == F.count(F.lit(1)), F.sum(c)).alias(f"{c}Total")
    rows = events.where("kind = 'capability-result'")
    return rows.groupBy("provider", "capabilityName", "projectKey").agg(
        F.count(F.lit(1)).alias("events"), whole("durationMs"), F.count("durationMs").alias("durationMsPresent"), whole("exitCode"), F.count("exitCode").alias("exitCodePresent"), F.min("eventKey").alias("firstEventKey")
    )


def token_hotspots(tokens: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """Per provider, model and project: the totals of the token metrics, each only if every event has it, how many have it, and the first event as evidence."""
    whole = [x for m in metrics for x in (F.when(F.count(m) == F.count(F.lit(1)), F.sum(m)).alias(f"{m}Total"), F.count(m).alias(f"{m}Present"))]
    return tokens.groupBy("provider", "model", "projectKey").agg(F.count(F.lit(1)).alias("events"), *whole, F.min("eventKey").alias("firstEventKey"))


def timeline(events: DataFrame) -> DataFrame:
    """Every session in source order: ordinal from 0, and how often the turn used the capability with the same input (null where that can't be told)."""
    same = ["turnKey", "capabilityKey", "inputFingerprint"]
    told = F.expr(" and ".join(f"{c} is not null" for c in same)) & (F.col("kind") == "capability-invocation")
    counts = events.where(told).groupBy("sessionKey", *same).agg(F.count(F.lit(1)).alias("_n"))
    rows = windows.numbered(events.select("eventKey", "sessionKey", "kind", *SOURCE, *same), ["sessionKey"], [*SOURCE, "eventKey"]).withColumn("ordinalInSession", F.col("row_no") - 1)
    out = rows.join(counts, ["sessionKey", *same], "left")
    return out.select("sessionKey", "ordinalInSession", "eventKey", "kind", F.when(told, windows.length_bucket(F.col("_n"))).alias("repeatBucket"))


def extraction_scores(turns: DataFrame, uses: DataFrame, chains: DataFrame, least: int = 3) -> DataFrame:
    """Sessions with at least `least` turns: recovered chains, uses per turn rounded half up, and whether a turn has an answer, as one score."""
    t = turns.where("visibility = 'active'").groupBy("sessionKey").agg(F.count(F.lit(1)).alias("turns"), F.max(F.col("finalAnswer").isNotNull().cast("int")).alias("conclusive")).where(F.col("turns") >= least)
    u = uses.groupBy("sessionKey").agg(F.count(F.lit(1)).alias("uses"))
    r = chains.where("status = 'resolved'").groupBy("sessionKey").agg(F.count(F.lit(1)).alias("recovered"))
    j = t.join(u, "sessionKey", "left").join(r, "sessionKey", "left").select("sessionKey", "turns", "conclusive", F.coalesce("uses", F.lit(0)).alias("uses"), F.coalesce("recovered", F.lit(0)).alias("recovered"))
    rate = F.expr("(10 * uses + turns div 2) div turns")
    return j.withColumn("score", 15 * F.col("recovered") + F.least(F.lit(10), rate) + 5 * F.col("conclusive"))


def overview(sessions: DataFrame) -> DataFrame:
    """Sessions per provider: by scope and eligibility, projects, duplicate groups, first and last time."""
    return sessions.groupBy("provider").agg(
        F.count(F.lit(1)).alias("sessions"), F.count_if(F.col("originScope") == "main").alias("main"), F.count_if(F.col("eligibility") == "eligible").alias("eligible"), F.count_distinct("projectKey").alias("projects"),
        F.count_distinct("groupKey").alias("groups"), F.min("startedAt").alias("firstAt"), F.max("endedAt").alias("lastAt"),
    )


def group_confidence(sessions: DataFrame) -> DataFrame:
    """Two-level aggregate: fingerprints of a duplicate group first, then the group: strong if a member is or if two share a fingerprint."""
    first = sessions.where("groupKey is not null").groupBy("groupKey", "fingerprint").agg(F.count(F.lit(1)).alias("_n"), F.bool_or(F.col("confidence") == "strong").alias("_s"))
    return first.groupBy("groupKey").agg(
        F.sum("_n").alias("members"), F.when(F.coalesce(F.bool_or("_s"), F.lit(False)) | F.coalesce(F.max(F.when(F.col("fingerprint").isNotNull(), F.col("_n"))) >= 2, F.lit(False)), "strong").otherwise("weak").alias("confidence")
    )


def chain_digest(rows: DataFrame, chain: list[str], block: int = 1000) -> DataFrame:
    """A digest of the ordered events of each chain, with their number: digests of blocks of `block` events, then of those, so no chain is held or ordered as a whole."""
    blocks = windows.numbered(rows.select(*chain, *[c for c in (*SOURCE, "eventKey") if c not in chain]), chain, [*SOURCE, "eventKey"]).select(*chain, "eventKey", F.col("row_no").alias("_n")).withColumn("_b", F.floor((F.col("_n") - 1) / block))
    inner = blocks.groupBy(*chain, "_b").agg(F.count(F.lit(1)).alias("_k"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "eventKey"))), lambda x: x["eventKey"]), "|"), 256).alias("_d"))
    return inner.groupBy(*chain).agg(F.sum("_k").alias("events"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_b", "_d"))), lambda x: x["_d"]), "|"), 256).alias("digest"))


def neighbours(edges: DataFrame, roots: DataFrame, hops: int) -> DataFrame:
    """(repositoryKey, root, nodeKey, hop): nodes within `hops` links from each root, at their least distance, over from -> to links."""
    links = edges.select("repositoryKey", "fromKey", "toKey").distinct()
    seen = frontier = roots.select("repositoryKey", "root", F.col("root").alias("nodeKey"), F.lit(0).alias("hop"))
    for hop in range(1, hops + 1):
        step = frontier.join(links, (frontier["repositoryKey"] == links["repositoryKey"]) & (frontier["nodeKey"] == links["fromKey"])).select(frontier["repositoryKey"], "root", F.col("toKey").alias("nodeKey")).distinct()
        frontier = step.join(seen.select("repositoryKey", "root", "nodeKey"), ["repositoryKey", "root", "nodeKey"], "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.unionByName(frontier)
    return seen


def head_and_tail(rows: DataFrame, entity: str, order: list[str], head: int, tail: int) -> DataFrame:
    """The first `head` and last `tail` rows of each entity, with which of both they are and whether anything between was left out."""
    n, z = F.col("row_no"), F.col("row_count") - F.col("row_no") + 1
    kept = windows.numbered(rows, [entity], order).where((n <= head) | (z <= tail))
    return kept.withColumn("part", F.when(n <= head, "head").otherwise("tail")).withColumn("truncated", (F.col("row_count") > head + tail).cast("int")).drop("row_no", "row_count")


def capped(rows: DataFrame, entity: str, order: list[str], first: Column, head: int, tail: int) -> DataFrame:
    """As head_and_tail, but rows for which `first` holds are all kept, as part `priority`, and don't count for the others."""
    must = rows.where(F.coalesce(first, F.lit(False))).withColumns({"part": F.lit("priority"), "truncated": F.lit(0)})
    return head_and_tail(rows.where(~F.coalesce(first, F.lit(False))), entity, order, head, tail).unionByName(must)
