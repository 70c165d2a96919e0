"""How capabilities are used: usage of a window against a baseline, contexts, attempts, activity by time and signals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnmill.operators import analyses as an
from turnmill.operators import joins, windows

#: What usage can be ordered by; most first.
ORDERS = {
    "invocations": lambda: F.col("invocations"), "failing": lambda: F.col("failed"), "turns": lambda: F.col("turns"), "sessions": lambda: F.col("sessions"), "groups": lambda: F.col("groups"),
    "last-used": lambda: F.col("lastUsedAt"), "absolute-change": lambda: F.abs("change"),
}
#: Rows of a page at most, and of the lists inside a row.
PAGE, LISTED = 50, 5


def outcome_of_turn(terminal: str = "terminal") -> Column:
    return F.when(F.col(terminal) == "completed", "provider-completed").when(F.col(terminal) == "aborted", "abandoned").otherwise("unknown")


def window_of(at: str, bounds: tuple[int | None, int | None]) -> Column:
    """at in [after, before); an open end is None."""
    after, before = bounds
    parts = ([F.col(at) >= after] if after is not None else []) + ([F.col(at) < before] if before is not None else [])
    return reduce(lambda a, b: a & b, parts, F.col(at).isNotNull())


def usage(uses: DataFrame, turns: DataFrame, sessions: DataFrame, window: tuple[int | None, int | None], baseline: tuple[int | None, int | None]) -> DataFrame:
    """One row per capability used in either window: counts by state, distinct turns, sessions and duplicate groups, turns by outcome and the last use in the
    window; invocations in the baseline and the signed change; retries over all history.

    Only uses of active turns count. A capability without use in a window counts 0 there. Uses without time are in no window."""
    active = turns.where("visibility = 'active'").select("turnKey", outcome_of_turn().alias("outcome"))
    rows = uses.join(active, "turnKey").join(sessions.select("sessionKey", "groupKey"), "sessionKey", "left")
    now = rows.where(window_of("observedAt", window)).groupBy("capabilityKey").agg(
        F.max("capabilityName").alias("capabilityName"), F.count(F.lit(1)).alias("invocations"), *(F.count_if(F.col("terminalState") == s).alias(s) for s in an.STATES),
        *(F.count_distinct(k).alias(n) for k, n in (("turnKey", "turns"), ("sessionKey", "sessions"), ("groupKey", "groups"))),
        *(F.count_distinct(F.when(F.col("outcome") == o, F.col("turnKey"))).alias(n) for o, n in (("provider-completed", "completedTurns"), ("abandoned", "abandonedTurns"), ("unknown", "unknownTurns"))), F.max("observedAt").alias("lastUsedAt"),
    )
    before = rows.where(window_of("observedAt", baseline)).groupBy("capabilityKey").agg(F.max("capabilityName").alias("_name"), F.count(F.lit(1)).alias("baseline"))
    again = windows.retries(uses, ["sessionKey"], [*an.SOURCE, "useKey"], ["failed"]).groupBy("capabilityKey").agg(F.sum("same_input_repeat_count").alias("repeats"), F.sum("retry_after_failure_count").alias("retries"))
    counts = ["invocations", *an.STATES, "turns", "sessions", "groups", "completedTurns", "abandonedTurns", "unknownTurns", "baseline"]
    both = now.join(before, "capabilityKey", "full_outer").select("capabilityKey", F.coalesce("capabilityName", "_name").alias("capabilityName"), *(F.coalesce(c, F.lit(0)).alias(c) for c in counts), "lastUsedAt")
    return both.withColumn("change", F.col("invocations") - F.col("baseline")).join(again, "capabilityKey", "left")


def usage_order(by: str) -> list[Column]:
    """The metric, then turns, sessions and last use, most first, and the key; unknown times are last."""
    if by not in ORDERS:
        raise ValueError(f"order is one of {', '.join(ORDERS)}")
    return [ORDERS[by]().desc_nulls_last(), F.desc("turns"), F.desc("sessions"), F.col("lastUsedAt").desc_nulls_last(), F.asc("capabilityKey")]


def page(rows: DataFrame, order: list[Column], limit: int = PAGE) -> DataFrame:
    """The first rows in order with `position` (from 1) and `more`, whether rows follow: one more row than asked for is read to tell."""
    line = Window.orderBy(*order)  # over limit + 1 rows
    probed = rows.orderBy(*order).limit(limit + 1).withColumn("position", F.row_number().over(line).cast("bigint"))
    return probed.withColumn("more", (F.max("position").over(Window.partitionBy(F.lit(1))) > limit).cast("int")).where(F.col("position") <= limit)


def behind(by: str, position: dict) -> Column:
    """Whether a row of usage() stands behind a row of an earlier page in an order. position has that row's metric as `metric`, and its turns, sessions, lastUsedAt and capabilityKey."""
    values = [(ORDERS[by](), position["metric"]), *((F.col(c), position[c]) for c in ("turns", "sessions", "lastUsedAt"))]
    out, same = F.lit(False), F.lit(True)
    for column, seen in values:  # most first, unknown last
        out = out | (same & (F.lit(False) if seen is None else (column < F.lit(seen)) | column.isNull()))
        same = same & column.eqNullSafe(F.lit(seen))
    return out | (same & (F.col("capabilityKey") > F.lit(position["capabilityKey"])))


def representative_turns(uses: DataFrame, k: int = LISTED) -> DataFrame:
    """(capabilityKey, turnKey, invocations, usedAt, rank): per capability the turns with most uses, newest first among equals."""
    counts = uses.where("turnKey is not null").groupBy("capabilityKey", "turnKey").agg(F.count(F.lit(1)).alias("invocations"), F.max("observedAt").alias("usedAt"))
    return windows.top_k(counts, ["capabilityKey"], [F.desc("invocations"), F.col("usedAt").desc_nulls_last(), F.asc("turnKey")], k)


def companions(uses: DataFrame, k: int = LISTED) -> DataFrame:
    """(capabilityKey, other, groups, rank): per capability those that occur most often in the same turns."""
    return windows.top_k(joins.co_occurrence(uses, "turnKey", "capabilityKey"), ["capabilityKey"], [F.desc("groups"), F.asc("other")], k)


def listed(rows: DataFrame, fields: list[str], name: str) -> DataFrame:
    """(capabilityKey, name): the rows of a ranking by capability as one JSON array in order of rank; a ranking has at most LISTED rows each."""
    items = F.transform(F.array_sort(F.collect_list(F.struct("rank", *fields))), lambda x: F.struct(*(x[f].alias(f) for f in fields)))
    return rows.groupBy("capabilityKey").agg(F.to_json(items).alias(name))


def contexts(uses: DataFrame, sessions: DataFrame) -> DataFrame:
    """capability_contexts with its top projects, companions and representative turns as JSON, ordered by groups and invocations; see page()."""
    out = an.capability_contexts(uses, sessions)
    for rows, fields, name in ((an.top_projects(uses), ["projectKey", "uses"], "topProjects"), (companions(uses), ["other", "groups"], "coOccurring"), (representative_turns(uses), ["turnKey", "invocations"], "representativeTurns")):
        out = out.join(listed(rows, fields, name), "capabilityKey", "left")
    return out


def attempts(uses: DataFrame) -> DataFrame:
    """(sessionKey, capabilityKey, attempt_no, useKey, terminalState, status) of every attempt of the chains that failure_chains reports, in order."""
    line = Window.partitionBy("sessionKey", "capabilityKey").orderBy(*an.SOURCE, "useKey")
    status = an.failure_chains(uses).select("sessionKey", "capabilityKey", "status")
    return uses.withColumn("attempt_no", F.row_number().over(line).cast("bigint")).join(status, ["sessionKey", "capabilityKey"]).select("sessionKey", "capabilityKey", "attempt_no", "useKey", "terminalState", "status")


def activity(events: DataFrame, turns: DataFrame, bucket, clock: int, idle: int) -> DataFrame:
    """Per bucket, empty ones included: what analyses.activity has, project switches, uses of tools and of skills, and turns by outcome and by closure.

    bucket: a function of a column name. Turns and events are counted apart, so that none multiplies the other; a turn is in the bucket of its own time."""
    from turnmill.operators.evidence import closure

    base = an.activity(events, bucket("observedAt"))
    switched = windows.context_switches(events.select("eventKey", "observedAt", "projectKey"), "observedAt", "eventKey", "projectKey").where("switched = 1").groupBy(bucket("observedAt").alias("bucket")).agg(F.count(F.lit(1)).alias("switches"))
    skill = F.col("capabilityName").startswith("skill:")
    used = events.where("kind = 'capability-invocation'").groupBy(bucket("observedAt").alias("bucket")).agg(F.count_if(~skill).alias("tools"), F.count_if(skill).alias("skills"))
    closed = closure(turns.where("visibility = 'active'"), "sessionKey", ["startOffset", "turnKey"], "observedAt", clock, idle).withColumn("outcome", outcome_of_turn())
    by = closed.groupBy(bucket("observedAt").alias("bucket")).agg(
        F.count(F.lit(1)).alias("ownTurns"), *(F.count_if(F.col("outcome") == o).alias(n) for o, n in (("provider-completed", "completedTurns"), ("abandoned", "abandonedTurns"), ("unknown", "unknownTurns"))),
        *(F.count_if(F.col("closure") == c).alias(n) for c, n in (("hard-sealed", "sealedTurns"), ("quiescent", "quiescentTurns"), ("open", "openTurns"))),
    )
    out = base
    for part in (switched, used, by):
        out = out.join(part, "bucket", "left")
    more = ["switches", "tools", "skills", "ownTurns", "completedTurns", "abandonedTurns", "unknownTurns", "sealedTurns", "quiescentTurns", "openTurns"]
    return out.select(*base.columns, *(F.coalesce(c, F.lit(0)).alias(c) for c in more))


def projects(sessions: DataFrame, turns: DataFrame, most: int = 512) -> DataFrame:
    """The projects with most sessions: sessions, active turns, duplicate groups, first and last time."""
    held = turns.where("visibility = 'active'").groupBy("sessionKey").agg(F.count(F.lit(1)).alias("turns"))
    rows = sessions.where("projectKey is not null").join(held, "sessionKey", "left").groupBy("projectKey").agg(
        F.count(F.lit(1)).alias("sessions"), F.coalesce(F.sum("turns"), F.lit(0)).alias("turns"), F.count_distinct("groupKey").alias("groups"), F.min("startedAt").alias("firstAt"), F.max("endedAt").alias("lastAt")
    )
    return rows.orderBy(F.desc("sessions"), "projectKey").limit(most)


def signals(rows: DataFrame, key: str, known: list[str], other: str = "other") -> DataFrame:
    """(signal, n, folded): how often each known key occurs; all unknown ones are one bucket, which tells that it was folded. Null keys are out."""
    safe = F.when(F.col(key).isin(known), F.col(key)).otherwise(other)
    return rows.where(F.col(key).isNotNull()).groupBy(safe.alias("signal")).agg(F.count(F.lit(1)).alias("n"), F.max((~F.col(key).isin(known)).cast("int")).alias("folded"))
