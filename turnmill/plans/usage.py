"""Queries on usage, contexts, activity, pages, coverage and rollups, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.operators import analyses as an
from turnmill.operators import query, rollups, search, usage
from turnmill.plans.reference import _APRIL, _MAY, _leaf, define
from turnmill.sources import facts

IDLE = 300_000_000

_STATES = ", ".join(f"count(*) FILTER (terminalState = '{s}') AS {s}" for s in an.STATES)
_COUNTS = ["invocations", *an.STATES, "turns", "sessions", "groups", "completedTurns", "abandonedTurns", "unknownTurns", "baseline"]
_USAGE = f""", u AS (SELECT us.*, se.groupKey, t.outcome FROM us JOIN (SELECT turnKey, CASE terminal WHEN 'completed' THEN 'provider-completed' WHEN 'aborted' THEN 'abandoned' ELSE 'unknown' END AS outcome FROM tu WHERE visibility = 'active') t ON t.turnKey = us.turnKey
  LEFT JOIN se ON se.sessionKey = us.sessionKey),
cur AS (SELECT capabilityKey, max(capabilityName) AS name, count(*) AS invocations, {_STATES}, count(DISTINCT turnKey) AS turns, count(DISTINCT sessionKey) AS sessions, count(DISTINCT groupKey) AS groups,
  count(DISTINCT turnKey) FILTER (outcome = 'provider-completed') AS "completedTurns", count(DISTINCT turnKey) FILTER (outcome = 'abandoned') AS "abandonedTurns", count(DISTINCT turnKey) FILTER (outcome = 'unknown') AS "unknownTurns", max(observedAt) AS "lastUsedAt"
  FROM u WHERE observedAt >= {_MAY} GROUP BY 1),
bas AS (SELECT capabilityKey, max(capabilityName) AS bname, count(*) AS baseline FROM u WHERE observedAt >= {_APRIL} AND observedAt < {_MAY} GROUP BY 1),
rt AS (SELECT capabilityKey, count(*) FILTER (inputFingerprint IS NOT NULL AND before IS NOT NULL) AS repeats, count(*) FILTER (inputFingerprint IS NOT NULL AND before = 'failed') AS retries
  FROM (SELECT *, lag(terminalState) OVER (PARTITION BY sessionKey, capabilityKey, inputFingerprint ORDER BY recordStart, contentIndex, ordinal, useKey) AS before FROM us) GROUP BY 1),
ug AS (SELECT capabilityKey, coalesce(name, bname) AS "capabilityName", {', '.join(f'coalesce("{c}", 0) AS "{c}"' for c in _COUNTS)}, "lastUsedAt", coalesce(invocations, 0) - coalesce(baseline, 0) AS change, repeats, retries FROM cur FULL JOIN bas USING (capabilityKey) LEFT JOIN rt USING (capabilityKey))
"""
_METRICS = {"invocations": "invocations", "failing": "failed", "turns": "turns", "sessions": "sessions", "groups": "groups", "last-used": '"lastUsedAt"', "absolute-change": "abs(change)"}


def _usage(spark: SparkSession, d: str) -> DataFrame:
    return usage.usage(facts.capability_uses(spark, d), facts.turns(spark, d), facts.sessions(spark, d), (_MAY, None), (_APRIL, _MAY))


@define("r_usage_compare", "us tu se", _USAGE + "SELECT * FROM ug")
def r_usage_compare(spark: SparkSession, d: str) -> DataFrame:
    return _usage(spark, d)


def _ordered(by: str) -> None:
    order = f'{_METRICS[by]} DESC NULLS LAST, turns DESC, sessions DESC, "lastUsedAt" DESC NULLS LAST, capabilityKey'
    sql = f"SELECT capabilityKey, row_number() OVER (ORDER BY {order}) AS position, CASE WHEN count(*) OVER () > 10 THEN 1 ELSE 0 END AS more FROM ug ORDER BY {order} LIMIT 10"
    define(f"r_usage_by_{by.replace('-', '_')}", "us tu se", _USAGE + sql)(lambda spark, d: usage.page(_usage(spark, d), usage.usage_order(by), 10).select("capabilityKey", "position", "more"))


for _by in usage.ORDERS:
    _ordered(_by)


@define("r_usage_page2", "us tu se", _USAGE + "SELECT capabilityKey, change FROM ug ORDER BY abs(change) DESC, turns DESC, sessions DESC, \"lastUsedAt\" DESC NULLS LAST, capabilityKey LIMIT 5 OFFSET 5")
def r_usage_page2(spark: SparkSession, d: str) -> DataFrame:
    """The page behind the fifth row, by the position of that row."""
    rows, order = _usage(spark, d), usage.usage_order("absolute-change")
    last = usage.page(rows, order, 5).where("position = 5").collect()
    if not last:
        return rows.select("capabilityKey", "change").limit(0)
    at = last[0].asDict()
    position = {k: at[k] for k in ("turns", "sessions", "lastUsedAt", "capabilityKey")} | {"metric": abs(at["change"])}
    return rows.where(usage.behind("absolute-change", position)).orderBy(*order).limit(5).select("capabilityKey", "change")


_LISTED = """tp AS (SELECT capabilityKey, '[' || string_agg('{"projectKey":"' || projectKey || '","uses":' || uses || '}', ',' ORDER BY rank) || ']' AS "topProjects" FROM (SELECT *, row_number() OVER (PARTITION BY capabilityKey ORDER BY uses DESC, lastAt DESC NULLS LAST, projectKey) AS rank FROM (SELECT capabilityKey, projectKey, count(*) AS uses, max(observedAt) AS lastAt FROM us WHERE projectKey IS NOT NULL GROUP BY 1, 2)) WHERE rank <= 5 GROUP BY 1),
pr AS (SELECT DISTINCT turnKey, capabilityKey FROM us WHERE turnKey IS NOT NULL AND capabilityKey IS NOT NULL), co AS (SELECT *, row_number() OVER (PARTITION BY capabilityKey ORDER BY groups DESC, other) AS rank FROM (SELECT a.capabilityKey, b.capabilityKey AS other, count(*) AS groups FROM pr a JOIN pr b ON a.turnKey = b.turnKey AND a.capabilityKey <> b.capabilityKey GROUP BY 1, 2)),
cl AS (SELECT capabilityKey, '[' || string_agg('{"other":"' || other || '","groups":' || groups || '}', ',' ORDER BY rank) || ']' AS "coOccurring" FROM co WHERE rank <= 5 GROUP BY 1),
rp AS (SELECT *, row_number() OVER (PARTITION BY capabilityKey ORDER BY invocations DESC, usedAt DESC NULLS LAST, turnKey) AS rank FROM (SELECT capabilityKey, turnKey, count(*) AS invocations, max(observedAt) AS usedAt FROM us WHERE turnKey IS NOT NULL GROUP BY 1, 2)),
rl AS (SELECT capabilityKey, '[' || string_agg('{"turnKey":"' || turnKey || '","invocations":' || invocations || '}', ',' ORDER BY rank) || ']' AS "representativeTurns" FROM rp WHERE rank <= 5 GROUP BY 1)"""
_CONTEXT = "SELECT capabilityKey, max(capabilityName) AS capabilityName, count(*) AS invocations, " + _STATES + ", count(DISTINCT turnKey) AS turns, count(DISTINCT sessionKey) AS sessions, count(DISTINCT groupKey) AS groups, count(DISTINCT CASE WHEN groupKey IS NULL THEN sessionKey END) AS ungrouped, count(DISTINCT CASE WHEN confidence = 'strong' THEN sessionKey END) AS strong, count(DISTINCT CASE WHEN confidence = 'weak' THEN sessionKey END) AS weak, max(observedAt) AS lastUsedAt FROM (SELECT us.*, se.groupKey, se.confidence FROM us LEFT JOIN se ON se.sessionKey = us.sessionKey) GROUP BY 1"


@define("r_capability_contexts_full", "us se", f', {_LISTED}, x AS ({_CONTEXT}) SELECT x.*, "topProjects", "coOccurring", "representativeTurns", row_number() OVER (ORDER BY groups DESC, turns DESC, sessions DESC, invocations DESC, x.capabilityKey) AS position FROM x LEFT JOIN tp USING (capabilityKey) LEFT JOIN cl USING (capabilityKey) LEFT JOIN rl USING (capabilityKey) ORDER BY groups DESC, turns DESC, sessions DESC, invocations DESC, x.capabilityKey LIMIT 50')
def r_capability_contexts_full(spark: SparkSession, d: str) -> DataFrame:
    order = [F.desc("groups"), F.desc("turns"), F.desc("sessions"), F.desc("invocations"), F.asc("capabilityKey")]
    return usage.page(usage.contexts(facts.capability_uses(spark, d), facts.sessions(spark, d)), order).drop("more")


@define("win_cooccurrence_top5", "us", ", " + _LISTED + " SELECT capabilityKey, other, groups, rank FROM co WHERE rank <= 5")
def win_cooccurrence_top5(spark: SparkSession, d: str) -> DataFrame:
    return usage.companions(facts.capability_uses(spark, d)).withColumn("rank", F.col("rank").cast("bigint"))


@define("win_representative_turns", "us", ", " + _LISTED + " SELECT capabilityKey, turnKey, invocations, usedAt, rank FROM rp WHERE rank <= 5")
def win_representative_turns(spark: SparkSession, d: str) -> DataFrame:
    return usage.representative_turns(facts.capability_uses(spark, d)).withColumn("rank", F.col("rank").cast("bigint"))


@define("r_failure_attempts", "fc", "SELECT * FROM (SELECT us.sessionKey, us.capabilityKey, row_number() OVER (PARTITION BY us.sessionKey, us.capabilityKey ORDER BY recordStart, contentIndex, ordinal, useKey) AS attempt_no, useKey, terminalState, fc.status FROM us JOIN fc ON fc.sessionKey = us.sessionKey AND fc.capabilityKey = us.capabilityKey)")
def r_failure_attempts(spark: SparkSession, d: str) -> DataFrame:
    return usage.attempts(facts.capability_uses(spark, d))


_DAY = "(observedAt // 86400000000)"
_WEEK = f"(({_DAY} + 3) // 7)"
_ACTIVITY = """, sw AS (SELECT *, CASE WHEN projectKey <> last_value(projectKey IGNORE NULLS) OVER (ORDER BY observedAt NULLS FIRST, eventKey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS switched FROM ev),
g AS (SELECT {b} AS bucket, count(*) AS events, count(DISTINCT sessionKey) AS sessions, count(DISTINCT turnKey) AS turns, count(DISTINCT projectKey) AS projects, count(*) FILTER (kind = 'capability-invocation') AS uses, sum(switched)::BIGINT AS switches,
  count(*) FILTER (kind = 'capability-invocation' AND NOT starts_with(capabilityName, 'skill:')) AS tools, count(*) FILTER (kind = 'capability-invocation' AND starts_with(capabilityName, 'skill:')) AS skills FROM sw WHERE observedAt IS NOT NULL GROUP BY 1),
cs AS (SELECT *, CASE WHEN lead(1) OVER (PARTITION BY sessionKey ORDER BY startOffset, turnKey) IS NOT NULL THEN 'hard-sealed' WHEN observedAt + {idle} <= {clock} THEN 'quiescent' ELSE 'open' END AS closure FROM tu WHERE visibility = 'active'),
t AS (SELECT {b} AS bucket, count(*) AS "ownTurns", count(*) FILTER (terminal = 'completed') AS "completedTurns", count(*) FILTER (terminal = 'aborted') AS "abandonedTurns", count(*) FILTER (coalesce(terminal, '') NOT IN ('completed', 'aborted')) AS "unknownTurns",
  count(*) FILTER (closure = 'hard-sealed') AS "sealedTurns", count(*) FILTER (closure = 'quiescent') AS "quiescentTurns", count(*) FILTER (closure = 'open') AS "openTurns" FROM cs GROUP BY 1),
c AS (SELECT unnest(range(lo, hi + 1)) AS bucket FROM (SELECT min({b}) AS lo, max({b}) AS hi FROM ev WHERE observedAt IS NOT NULL))
SELECT c.bucket, {columns} FROM c LEFT JOIN g ON g.bucket = c.bucket LEFT JOIN t ON t.bucket = c.bucket"""
_MEASURES = ["events", "sessions", "turns", "projects", "uses", "switches", "tools", "skills", "ownTurns", "completedTurns", "abandonedTurns", "unknownTurns", "sealedTurns", "quiescentTurns", "openTurns"]


def _activity(name: str, sql: str, bucket) -> None:
    columns = ", ".join(f'coalesce("{m}", 0) AS "{m}"' for m in _MEASURES)
    define(name, "ev tu", _ACTIVITY.format(b=sql, idle=IDLE, clock=_MAY, columns=columns))(lambda spark, d: usage.activity(facts.events(spark, d), facts.turns(spark, d), bucket, _MAY, IDLE))


_activity("r_activity_full_day", _DAY, an.day)
_activity("r_activity_full_week", _WEEK, an.week)


@define("r_overview_projects", "se tu", 'SELECT projectKey, count(*) AS sessions, coalesce(sum(n), 0)::BIGINT AS turns, count(DISTINCT groupKey) AS groups, min(startedAt) AS "firstAt", max(endedAt) AS "lastAt" FROM se LEFT JOIN (SELECT sessionKey, count(*) AS n FROM tu WHERE visibility = \'active\' GROUP BY 1) USING (sessionKey) WHERE projectKey IS NOT NULL GROUP BY 1 ORDER BY sessions DESC, projectKey LIMIT 512')
def r_overview_projects(spark: SparkSession, d: str) -> DataFrame:
    return usage.projects(facts.sessions(spark, d), facts.turns(spark, d))


_KNOWN = ["read_file", "search_text", "shell_exec"]


@define("agg_safe_keys", "ev", "SELECT CASE WHEN capabilityName IN ('read_file', 'search_text', 'shell_exec') THEN capabilityName ELSE 'other' END AS signal, count(*) AS n, max(CASE WHEN capabilityName IN ('read_file', 'search_text', 'shell_exec') THEN 0 ELSE 1 END) AS folded FROM ev WHERE error IS NOT NULL AND capabilityName IS NOT NULL GROUP BY 1")
def agg_safe_keys(spark: SparkSession, d: str) -> DataFrame:
    """Errors by known capability, all others as one."""
    return usage.signals(facts.events(spark, d, "error is not null"), "capabilityName", _KNOWN)


@define("agg_argmin_evidence", "ev tu", "SELECT provider, capabilityName, min(eventKey) AS \"firstEventKey\", arg_min(revision, eventKey) AS \"firstRevision\" FROM ev JOIN (SELECT turnKey, revision FROM tu) USING (turnKey) WHERE kind = 'capability-result' GROUP BY 1, 2")
def agg_argmin_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The first event per group as its evidence, with the revision of its turn."""
    rows = facts.events(spark, d, "kind = 'capability-result'").select("eventKey", "turnKey", "provider", "capabilityName").join(facts.turns(spark, d).select("turnKey", "revision"), "turnKey")
    return rows.groupBy("provider", "capabilityName").agg(F.min("eventKey").alias("firstEventKey"), F.min_by("revision", "eventKey").alias("firstRevision"))


_PROBE = {"resource": "event", "where": _leaf("event.kind", "eq", "capability-result"), "shape": {"kind": "records", "fields": ["eventKey", "observedAt"]}, "limit": 20}


@define("q_probe_more", "ev", "SELECT eventKey, observedAt, CASE WHEN count(*) OVER () > 20 THEN 1 ELSE 0 END AS more FROM ev WHERE kind = 'capability-result' ORDER BY observedAt DESC NULLS LAST, eventKey LIMIT 20")
def q_probe_more(spark: SparkSession, d: str) -> DataFrame:
    return query.probed(facts.source("event", spark, d), _PROBE)


@define("q_exact_count", "ev", "SELECT count(*) AS n FROM ev WHERE kind = 'capability-result'")
def q_exact_count(spark: SparkSession, d: str) -> DataFrame:
    return query.exact_count(facts.source("event", spark, d), _PROBE)


_HOUR = 3_600_000_000


@define("q_newest", "ev", f"SELECT eventKey, observedAt FROM ev WHERE error IS NOT NULL AND observedAt >= {_APRIL} AND observedAt < {_APRIL + 48 * _HOUR}")
def q_newest(spark: SparkSession, d: str) -> DataFrame:
    """All errors of two days, newest first, or none at all."""
    return query.newest(facts.events(spark, d, "error is not null").select("eventKey", "observedAt"), "observedAt", ["eventKey"], (_APRIL, _APRIL + 48 * _HOUR))


def _hidden(spark: SparkSession, d: str) -> DataFrame:
    return facts.sessions(spark, d).where("confidence = 'weak'").select("sessionKey")


@define("q_visibility_antijoin", "tu se", "SELECT turnKey FROM tu WHERE visibility = 'active' AND NOT EXISTS (SELECT 1 FROM se WHERE se.sessionKey = tu.sessionKey AND se.confidence = 'weak')")
def q_visibility_antijoin(spark: SparkSession, d: str) -> DataFrame:
    """Active turns of sessions that aren't hidden; weak copies stand for hidden ones."""
    return query.visible(facts.turns(spark, d), _hidden(spark, d), visibility="visibility").select("turnKey")


@define("q_filters", "ev", f"SELECT eventKey FROM ev WHERE provider IN ('claude', 'codex') AND kind IN ('capability-result', 'visible-message') AND observedAt >= {_APRIL} AND observedAt < {_MAY}")
def q_filters(spark: SparkSession, d: str) -> DataFrame:
    filters = {"providers": ["claude", "codex"], "eventKinds": ["capability-result", "visible-message"], "window": [_APRIL, _MAY]}
    return query.narrowed(facts.events(spark, d), filters).select("eventKey")


@define("q_match_leaf", "ev", f"SELECT eventKey, observedAt FROM ev WHERE observedAt >= {_APRIL} AND list_has_any(regexp_extract_all(lower(coalesce(output, '')), '[a-z0-9]+'), ['checkpoint', 'snapshot']) ORDER BY observedAt DESC NULLS LAST, eventKey LIMIT 50")
def q_match_leaf(spark: SparkSession, d: str) -> DataFrame:
    """A request whose predicate has a match leaf, which the planner turns into a semi-join with postings."""
    where = {"and": [_leaf("observedAt", "gte", _APRIL), {"field": "text", "op": "match", "value": "checkpoint snapshot"}]}
    request = {"resource": "event", "where": where, "shape": {"kind": "records", "fields": ["eventKey", "observedAt"]}}
    return query.records(facts.source("event", spark, d), request, matches=lambda rows, leaf: rows.join(search.ascii_hits(rows, "eventKey", "output", leaf["value"].split()), "eventKey", "left_semi"))


@define("q_aggregate_page2", "us", 'SELECT capabilityName AS "capability_canonicalName", count(*) AS n FROM us GROUP BY 1 ORDER BY n DESC, 1 NULLS FIRST LIMIT 5 OFFSET 5')
def q_aggregate_page2(spark: SparkSession, d: str) -> DataFrame:
    """Groups by a metric, and by key among equals; the second page by offset."""
    shape = {"kind": "aggregate", "groupBy": ["capability.canonicalName"], "metrics": [{"name": "n", "op": "count"}], "orderBy": {"metric": "n"}, "offset": 5}
    return query.aggregate(facts.source("capability-use", spark, d), {"resource": "capability-use", "shape": shape, "limit": 5}, max_groups=10_000, max_distinct=500_000)


@define("agg_session_coverage", "ev se", "SELECT count(*) AS sessions, count(se.sessionKey) AS known, count(*) FILTER (se.sessionKey IS NULL) AS unknown, count(*) FILTER (se.confidence = 'weak') AS hidden, count(*) FILTER (whole) AS complete FROM (SELECT sessionKey, bool_and(completeness = 'full') AS whole FROM ev WHERE error IS NOT NULL AND sessionKey IS NOT NULL GROUP BY 1) o LEFT JOIN se ON se.sessionKey = o.sessionKey")
def agg_session_coverage(spark: SparkSession, d: str) -> DataFrame:
    return query.session_coverage(facts.events(spark, d, "error is not null"), facts.sessions(spark, d), _hidden(spark, d))


@define("r_with_coverage", "ev", "SELECT capabilityName, count(*) AS n, 'derived' AS provenance, (SELECT count(*) FROM ev WHERE error IS NOT NULL) AS \"coverageEvents\", (SELECT CASE WHEN bool_or(completeness <> 'full' OR observedAt IS NULL) THEN 1 ELSE 0 END FROM ev WHERE error IS NOT NULL) AS degraded FROM ev WHERE error IS NOT NULL GROUP BY 1")
def r_with_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Errors per capability, with the coverage of exactly the events that were read."""
    rows = facts.events(spark, d, "error is not null")
    return query.with_coverage(rows, rows.groupBy("capabilityName").agg(F.count(F.lit(1)).alias("n")), "derived")


_DAYS = (_APRIL // 86_400_000_000, _MAY // 86_400_000_000)
_ROLLED = f"SELECT provider, kind, count(*) AS n, coalesce(sum(durationMs), 0)::DECIMAL(38,0) AS \"durationMs_sum\", count(durationMs) AS \"durationMs_present\", count(DISTINCT sessionKey) AS \"sessionKeys\", count(DISTINCT turnKey) AS \"turnKeys\" FROM ev WHERE observedAt >= {_APRIL} AND observedAt < {_MAY} GROUP BY 1, 2"


@define("agg_day_rollup", "ev", _ROLLED)
def agg_day_rollup(spark: SparkSession, d: str) -> DataFrame:
    """A month from day rollups; the SQL takes it from the rows."""
    rows, keys = facts.events(spark, d), ["provider", "kind"]
    members = {m: rollups.day_members(rows, keys, "observedAt", m) for m in ("sessionKey", "turnKey")}
    return rollups.merged(rollups.day_counts(rows, keys, "observedAt", ["durationMs"]), members, keys, ["durationMs"], _DAYS)


@define("agg_rollup_shortcut", "ev", f"SELECT provider, count(*) AS n, coalesce(sum(durationMs), 0)::DECIMAL(38,0) AS total FROM ev WHERE observedAt >= {_APRIL} AND observedAt < {_MAY} GROUP BY 1")
def agg_rollup_shortcut(spark: SparkSession, d: str) -> DataFrame:
    """A request that day rollups can answer."""
    request = {"resource": "event", "where": _leaf("observedAt", "between", [_APRIL, _MAY]), "shape": {"kind": "aggregate", "groupBy": ["provider"], "metrics": [{"name": "n", "op": "count"}, {"name": "total", "op": "sum", "field": "event.durationMs"}]}}
    query.validate(request)
    counts = rollups.day_counts(facts.events(spark, d), ["provider", "kind"], "observedAt", ["durationMs"])
    return rollups.shortcut(request, counts, {"provider": "provider", "event.kind": "kind"}, {"event.durationMs": "durationMs"})
