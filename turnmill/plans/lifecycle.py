"""Queries on changes of sources, hiding and purging, copies, documents, transcripts and status, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.operators import analyses as an
from turnmill.operators import evidence, lifecycle
from turnmill.plans.reference import _APRIL, _MAY, define
from turnmill.sources import facts
from turnmill.sources.tables import table

IDLE = 300_000_000


@define("s_change_classes", "ev", f"""SELECT coalesce(o.sessionKey, n.sessionKey) AS source, CASE WHEN n.sessionKey IS NULL THEN 'missing' WHEN n.excluded THEN 'excluded' WHEN o.sessionKey IS NULL THEN 'new' WHEN o.head = n.head AND n.size = o.size THEN 'unchanged' WHEN o.head = n.head AND n.size > o.size THEN 'append' ELSE 'replace' END AS change
FROM (SELECT sessionKey, count(*) AS size, min(eventKey) AS head FROM ev WHERE observedAt < {_MAY} GROUP BY 1) o FULL JOIN (SELECT sessionKey, count(*) AS size, min(eventKey) AS head, bool_or(originScope = 'subagent') AS excluded FROM ev WHERE observedAt >= {_APRIL} GROUP BY 1) n ON n.sessionKey = o.sessionKey""")
def s_change_classes(spark: SparkSession, d: str) -> DataFrame:
    """Sessions as of two scans: events before May, and from April on."""
    e = facts.events(spark, d)
    scan = lambda rows: rows.groupBy(F.col("sessionKey").alias("source")).agg(F.count(F.lit(1)).alias("size"), F.min("eventKey").alias("head"), F.bool_or(F.col("originScope") == "subagent").alias("excluded"))
    return lifecycle.classify_changes(scan(e.where(F.col("observedAt") < _MAY)), scan(e.where(F.col("observedAt") >= _APRIL)))


def _states(spark: SparkSession, d: str) -> DataFrame:
    """Commands on sessions from what is known of them: all are included, those of weak copies then excluded, strong copies purged, and other providers' included again."""
    s = facts.sessions(spark, d)
    part = lambda where, seq, command: s.where(where).select("sessionKey", F.lit(seq).alias("sequence"), F.lit(command).alias("command"))
    rows = part("true", 0, "include").unionByName(part("confidence = 'weak'", 1, "exclude")).unionByName(part("confidence = 'strong'", 2, "purge")).unionByName(part("provider = 'other'", 3, "include"))
    return lifecycle.source_states(rows)


_STATES = ", st AS (SELECT sessionKey, CASE WHEN confidence = 'strong' THEN 'purged' WHEN confidence = 'weak' AND provider <> 'other' THEN 'hidden' ELSE 'visible' END AS state FROM se)"


@define("s_source_states", "se", _STATES + " SELECT sessionKey, state FROM st")
def s_source_states(spark: SparkSession, d: str) -> DataFrame:
    return _states(spark, d)


@define("s_shown", "ev se", _STATES + " SELECT eventKey FROM ev WHERE sessionKey IS NULL OR sessionKey NOT IN (SELECT sessionKey FROM st WHERE state <> 'visible')")
def s_shown(spark: SparkSession, d: str) -> DataFrame:
    """Events that are still shown while hidden and purged sources lie in the tables."""
    return lifecycle.shown(facts.events(spark, d).select("eventKey", "sessionKey"), _states(spark, d)).select("eventKey")


@define("s_caught_up", "", "SELECT session_key, count(DISTINCT turn_key) AS turns, max(epoch_us(observed_timestamp)) AS position FROM turn_upserts WHERE observed_timestamp IS NOT NULL GROUP BY 1")
def s_caught_up(spark: SparkSession, d: str) -> DataFrame:
    """A projection of turns per session that held what came before May, after the rest of the log."""
    log = table(spark, d, "turn_upserts").where("observed_timestamp is not null").select("session_key", "turn_key", facts.micros("observed_timestamp").alias("position"))
    project = lambda rows: rows.groupBy("session_key").agg(F.count_distinct("turn_key").alias("turns"), F.max("position").alias("position"))
    return lifecycle.caught_up(project(log.where(F.col("position") < _MAY)), log, project, "session_key", "position", _MAY - 1)


@define("r_lineages", "se", """, b AS (SELECT *, coalesce('g' || groupKey, 'f' || fingerprint, 's' || sessionKey) AS by_ FROM se), p AS (SELECT by_, fingerprint, count(*) AS n FROM b GROUP BY 1, 2),
g AS (SELECT by_, min(sessionKey) AS lineage, count(*) AS members, coalesce(max(CASE WHEN method = 'explicit-lineage' THEN 1 ELSE 0 END), 0) AS ex FROM b GROUP BY 1), m AS (SELECT by_, coalesce(max(n) FILTER (fingerprint IS NOT NULL), 0) AS same FROM p GROUP BY 1)
SELECT sessionKey, lineage, members, CASE WHEN members = 1 THEN 'none' WHEN starts_with(by_, 'g') AND (ex = 1 OR same >= 2) THEN 'strong' ELSE 'weak' END AS confidence FROM b JOIN g USING (by_) JOIN m USING (by_)""")
def r_lineages(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.lineages(facts.sessions(spark, d))


@define("s_gap_sessions", "ev", """, o AS (SELECT *, CASE WHEN observedAt < lag(observedAt) OVER w + 1800000000 THEN 0 ELSE 1 END AS fresh FROM ev WHERE observedAt IS NOT NULL AND projectKey IS NOT NULL WINDOW w AS (PARTITION BY projectKey ORDER BY observedAt)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY projectKey ORDER BY observedAt ROWS UNBOUNDED PRECEDING) AS no FROM o) SELECT projectKey, min(observedAt) AS start_us, max(observedAt) + 1800000000 AS end_us, count(*) AS n FROM g GROUP BY projectKey, no""")
def s_gap_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Work on each project without a pause of half an hour."""
    rows = facts.events(spark, d, "observedAt is not null and projectKey is not null").select("projectKey", F.timestamp_micros("observedAt").alias("at"))
    return lifecycle.gap_sessions(rows, "projectKey", "at", "30 minutes").select("projectKey", F.unix_micros("session_start").alias("start_us"), F.unix_micros("session_end").alias("end_us"), "n")


@define("t_review_queue", "", "SELECT doc_id AS id, lang FROM documents WHERE source = 'memory-entry' AND project_key IS NOT NULL AND lang = 'en' AND n_chars > 100 ORDER BY doc_id LIMIT 25")
def t_review_queue(spark: SparkSession, d: str) -> DataFrame:
    """English memory entries of projects that wait for review; the language stands in their JSON metadata."""
    docs = table(spark, d, "documents").where("source = 'memory-entry' and n_chars > 100")
    entries = docs.select(F.col("doc_id").alias("id"), F.when(F.col("project_key").isNotNull(), "project").otherwise("none").alias("owner"), F.lit("waiting").alias("status"), F.to_json(F.struct(F.col("lang").alias("kind"))).alias("metadata"))
    return lifecycle.review_queue(entries, "project", "waiting", "en", 25).select("id", F.get_json_object("metadata", "$.kind").alias("lang"))


@define("r_heat", "se", """, o AS (SELECT session_key AS scene, count(DISTINCT delta_id) AS heat FROM session_commits WHERE session_key IS NOT NULL GROUP BY 1) SELECT scene, heat FROM o UNION ALL SELECT groupKey, (1 + coalesce(sum(heat), 0))::BIGINT FROM se LEFT JOIN o ON o.scene = se.sessionKey WHERE groupKey IS NOT NULL GROUP BY 1""")
def r_heat(spark: SparkSession, d: str) -> DataFrame:
    """Sessions warm up with each of their deltas, and a duplicate group merges its sessions."""
    deltas = table(spark, d, "session_commits").where("session_key is not null").select("session_key", "delta_id").distinct()
    own = deltas.select(F.col("session_key").alias("scene"), F.lit("update").alias("op"), F.lit(None).cast("array<string>").alias("merged"))
    merges = facts.sessions(spark, d).where("groupKey is not null").groupBy(F.col("groupKey").alias("scene")).agg(F.collect_set("sessionKey").alias("merged")).select("scene", F.lit("merge").alias("op"), "merged")
    return lifecycle.heat(own.unionByName(merges))


def _entries(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "session_messages").where("session_key is not null and seq_no is not null")
    return rows.groupBy("session_key", "seq_no").agg(F.min(F.struct("entry_kind", "speaker_role", "markdown")).alias("e")).select("session_key", "seq_no", F.lower(F.trim("e.entry_kind")).alias("entry_kind"), F.lower(F.trim("e.speaker_role")).alias("role"), F.col("e.markdown").alias("markdown"))


_ENTRIES = """WITH e AS (SELECT session_key, seq_no, lower(trim(entry_kind)) AS entry_kind, lower(trim(speaker_role)) AS role, markdown FROM (SELECT * FROM session_messages WHERE session_key IS NOT NULL AND seq_no IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY session_key, seq_no ORDER BY entry_kind NULLS FIRST, speaker_role NULLS FIRST, markdown NULLS FIRST) = 1))
"""


@define("s_history_round_trip", "", _ENTRIES + "SELECT session_key, seq_no, role, markdown FROM e")
def s_history_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Sessions as portable documents, 16 entries a page, and read back."""
    docs = lifecycle.documents(_entries(spark, d), "session_key", "seq_no", ["role", "markdown"], 16)
    return lifecycle.imported(docs, "session_key", "seq_no", ["role", "markdown"])


@define("t_transcript", "", _ENTRIES + """, n AS (SELECT *, coalesce(entry_kind = 'message', false) AS said, row_number() OVER (PARTITION BY session_key ORDER BY seq_no) AS rn FROM e), g AS (SELECT *, rn - row_number() OVER (PARTITION BY session_key, said ORDER BY rn) AS g FROM n),
l AS (SELECT session_key, seq_no, rn, coalesce(role, '?') || ': ' || coalesce(markdown, '') AS line FROM g WHERE said UNION ALL SELECT session_key, min(seq_no), min(rn), '[' || count(*) || ' other entries]' FROM g WHERE NOT said GROUP BY session_key, g)
SELECT session_key, (seq_no // 16)::BIGINT AS page_no, string_agg(line, chr(10) ORDER BY rn) AS body FROM l GROUP BY 1, 2""")
def t_transcript(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.transcript(_entries(spark, d), "session_key", "seq_no", "entry_kind", "role", "markdown", 16)


_TABLES = {"sessions": ("session_key", "observed_end"), "session_commits": ("delta_id", "received_at"), "turn_upserts": ("turn_key", "observed_timestamp"), "history_events": ("event_key", "observed_at"), "session_messages": ("entry_id", "received_at"), "git_commits": ("object_id", "scanned_at"), "documents": ("doc_id", "collected_at"), "eval_items": ("item_id", None)}


@define("r_status", "", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS rows, count(DISTINCT {k}) AS keys, count(*) FILTER ({k} IS NULL) AS \"nullKeys\", {f'max(epoch_us({a}))' if a else 'NULL::BIGINT'} AS \"lastAt\" FROM {t}" for t, (k, a) in _TABLES.items()))
def r_status(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.table_status({t: (table(spark, d, t), k, a) for t, (k, a) in _TABLES.items()})


_CLOSED = f", cl AS (SELECT *, CASE WHEN lead(1) OVER (PARTITION BY sessionKey ORDER BY startOffset, turnKey) IS NOT NULL THEN 'hard-sealed' WHEN observedAt + {IDLE} <= {_MAY} THEN 'quiescent' ELSE 'open' END AS closure FROM tu)"


@define("e_closure_sealed", "ev tu se", _CLOSED + " SELECT turnKey, CASE WHEN closure = 'hard-sealed' OR (terminal IS NOT NULL AND turnKey IN (SELECT turnKey FROM ev WHERE kind = 'turn-lifecycle' AND turnKey IS NOT NULL)) THEN 'hard-sealed' WHEN closure = 'quiescent' AND sessionKey IN (SELECT sessionKey FROM se WHERE endedAt IS NOT NULL) THEN 'quiescent' ELSE 'open' END AS closure FROM cl")
def e_closure_sealed(spark: SparkSession, d: str) -> DataFrame:
    sealed = facts.events(spark, d, "kind = 'turn-lifecycle' and turnKey is not null").select("turnKey")
    ended = facts.sessions(spark, d).where("endedAt is not null").select("sessionKey")
    return evidence.sealed_closure(facts.turns(spark, d), sealed, ended, "sessionKey", ["startOffset", "turnKey"], "observedAt", _MAY, IDLE).select("turnKey", "closure")


@define("r_session_analysis", "us tu se", _STATES + _CLOSED + """, rt AS (SELECT turnKey, count(*) AS uses, count(*) FILTER (terminalState = 'failed') AS failed, count(*) FILTER (inputFingerprint IS NOT NULL AND before IS NOT NULL) AS repeats, count(*) FILTER (inputFingerprint IS NOT NULL AND before IN ('failed', 'cancelled')) AS retries
FROM (SELECT *, lag(terminalState) OVER (PARTITION BY turnKey, capabilityKey, inputFingerprint ORDER BY recordStart, contentIndex, ordinal, useKey) AS before FROM us WHERE turnKey IS NOT NULL) GROUP BY 1)
SELECT cl.sessionKey, cl.turnKey, closure, visibility, coalesce(uses, 0) AS uses, coalesce(failed, 0) AS failed, coalesce(repeats, 0) AS repeats, coalesce(retries, 0) AS retries,
CASE WHEN state = 'purged' THEN 'purged' WHEN state = 'hidden' THEN 'hidden' WHEN visibility <> 'active' THEN 'rolled-back' WHEN closure = 'open' THEN 'not-sealed' END AS excluded FROM cl LEFT JOIN rt ON rt.turnKey = cl.turnKey LEFT JOIN st ON st.sessionKey = cl.sessionKey""")
def r_session_analysis(spark: SparkSession, d: str) -> DataFrame:
    turns = facts.turns(spark, d)
    closed = evidence.closure(turns, "sessionKey", ["startOffset", "turnKey"], "observedAt", _MAY, IDLE)
    return lifecycle.session_analysis(turns, facts.capability_uses(spark, d), closed, _states(spark, d))


@define("e_states_as_of", "ev", "SELECT sessionKey, capabilityName, arg_max(outcome, n) AS state FROM (SELECT *, CASE WHEN state IN ('failed', 'error') THEN 'failed' WHEN state = 'completed' THEN 'completed' WHEN state = 'cancelled' THEN 'cancelled' WHEN exitCode = 0 THEN 'completed' WHEN exitCode IS NOT NULL THEN 'failed' ELSE 'unknown' END AS outcome, row_number() OVER (PARTITION BY sessionKey ORDER BY recordStart, contentIndex, ordinal, eventKey) AS n FROM ev) WHERE n <= 12 AND kind = 'capability-result' AND capabilityName IS NOT NULL GROUP BY 1, 2")
def e_states_as_of(spark: SparkSession, d: str) -> DataFrame:
    """The state of each tool as the first twelve records of a session tell it."""
    e = facts.events(spark, d).select("sessionKey", "eventKey", "kind", "capabilityName", "state", "exitCode", *an.SOURCE)
    return evidence.state_as_of(e.withColumn("_o", facts.outcome()), "sessionKey", [*an.SOURCE, "eventKey"], "capabilityName", F.when(F.col("kind") == "capability-result", F.col("_o")), 12)


@define("e_capped", "ev", "SELECT eventKey, 'priority' AS part, 0 AS truncated FROM ev WHERE coalesce(state = 'failed', false) UNION ALL SELECT eventKey, CASE WHEN a <= 3 THEN 'head' ELSE 'tail' END, CASE WHEN n > 5 THEN 1 ELSE 0 END FROM (SELECT *, row_number() OVER (PARTITION BY sessionKey ORDER BY recordStart, contentIndex, ordinal, eventKey) AS a, row_number() OVER (PARTITION BY sessionKey ORDER BY recordStart DESC, contentIndex DESC, ordinal DESC, eventKey DESC) AS z, count(*) OVER (PARTITION BY sessionKey) AS n FROM ev WHERE NOT coalesce(state = 'failed', false)) WHERE a <= 3 OR z <= 2")
def e_capped(spark: SparkSession, d: str) -> DataFrame:
    """All failures of a session, and of its other events the first three and last two."""
    rows = facts.events(spark, d).select("eventKey", "sessionKey", "state", *an.SOURCE)
    return an.capped(rows, "sessionKey", [*an.SOURCE, "eventKey"], F.col("state") == "failed", 3, 2).select("eventKey", "part", "truncated")


@define("t_state_maps", "us", """SELECT capabilityKey, '{' || string_agg('"' || terminalState || '":' || n, ',' ORDER BY terminalState) || '}' AS states FROM (SELECT capabilityKey, terminalState, count(*) AS n FROM us GROUP BY 1, 2) GROUP BY 1""")
def t_state_maps(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.state_maps(facts.capability_uses(spark, d), "capabilityKey", F.col("terminalState")).withColumn("states", F.to_json("states"))


@define("q_session_list", "se", "SELECT sessionKey, endedAt FROM se ORDER BY endedAt DESC NULLS LAST, sessionKey LIMIT 20 OFFSET 20")
def q_session_list(spark: SparkSession, d: str) -> DataFrame:
    """The second page of the session list, newest first."""
    return facts.sessions(spark, d).select("sessionKey", "endedAt").orderBy(F.col("endedAt").desc_nulls_last(), "sessionKey").offset(20).limit(20)


@define("e_turn_evidence", "ev tu", """, x AS (SELECT turnKey, eventKey AS key, 0 AS kindRank, recordStart, contentIndex, ordinal, '{"eventKey":"' || eventKey || '","kind":"' || kind || '"}' AS line FROM ev WHERE turnKey IS NOT NULL
UNION ALL SELECT turnKey, turnKey, 1, startOffset, 0, 0, '{"turnKey":"' || turnKey || '","visibility":"' || visibility || '"}' FROM tu)
SELECT turnKey, row_number() OVER (PARTITION BY turnKey ORDER BY kindRank, recordStart, contentIndex, ordinal, key) - 1 AS line_no, line FROM x""")
def e_turn_evidence(spark: SparkSession, d: str) -> DataFrame:
    """All evidence of a turn as JSON lines: its events in source order, then the turn itself."""
    zero = F.lit(0)
    a = facts.events(spark, d, "turnKey is not null").select(zero.cast("bigint").alias("kindRank"), "turnKey", F.col("eventKey").alias("key"), *an.SOURCE, F.to_json(F.struct("eventKey", "kind")).alias("line"))
    b = facts.turns(spark, d).select(F.lit(1).cast("bigint").alias("kindRank"), "turnKey", F.col("turnKey").alias("key"), F.col("startOffset").alias("recordStart"), zero.alias("contentIndex"), zero.alias("ordinal"), F.to_json(F.struct("turnKey", "visibility")).alias("line"))
    from turnmill.operators.windows import numbered

    return numbered(a.unionByName(b), ["turnKey"], ["kindRank", *an.SOURCE, "key"], stretch=1).select("turnKey", (F.col("row_no") - 1).cast("bigint").alias("line_no"), "line")
