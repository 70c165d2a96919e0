"""Queries on search over turns, memory search and recall, budgets and set sizes, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnmill.operators import analyses as an
from turnmill.operators import search
from turnmill.plans.reference import define
from turnmill.sources import facts
from turnmill.sources.tables import table

QUERY, PHRASE = "Checkpoint lib/cursor.py purge marker apply_patch", "purge marker"

_CODE = search.FIELD_PATTERNS["code"]
_ASKED = ", ".join(f"('{f}', '{t}')" for f, t in search.ascii_query(QUERY))
_SEARCH = f""", d AS (SELECT turnKey, observedAt, lower(coalesce(problem, '')) AS low FROM tu),
tk AS (SELECT turnKey, 'natural' AS field, unnest(regexp_extract_all(low, '[a-z0-9]+')) AS term FROM d UNION ALL SELECT turnKey, 'code', unnest(regexp_extract_all(low, '{_CODE}')) FROM d
  UNION ALL SELECT DISTINCT turnKey, 'capability', lower(capabilityName) FROM us SEMI JOIN tu USING (turnKey) WHERE originScope = 'main' AND capabilityName IS NOT NULL),
ln_ AS (SELECT turnKey, count(*) AS len FROM tk GROUP BY 1), st AS (SELECT count(*) AS n, avg(len) AS mean FROM ln_),
q(field, term) AS (VALUES {_ASKED}), p AS (SELECT turnKey, field, term, count(*) AS tf FROM tk JOIN q USING (field, term) GROUP BY 1, 2, 3), df AS (SELECT field, term, count(*) AS df FROM p GROUP BY 1, 2),
sel AS (SELECT field, term, df, ln((n + 1)::DOUBLE / (df + 1)) + 1 AS idf, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS bm, CASE field WHEN 'natural' THEN 8.0::DOUBLE WHEN 'code' THEN 4.0::DOUBLE ELSE 2.0::DOUBLE END AS w FROM df, st WHERE field = 'capability' OR df * 5 <= n),
b AS (SELECT turnKey, round(sum(bm * (tf * w) * 2.2::DOUBLE / (tf * w + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))) * 1000000)::BIGINT AS score, sum(idf) AS matched FROM p JOIN sel USING (field, term) JOIN ln_ USING (turnKey), st GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, turnKey) AS rank FROM b),
o AS (SELECT turnKey, observedAt, round((0.45::DOUBLE * 61 / (60 + rank) + 0.40::DOUBLE * matched / (SELECT sum(idf) FROM sel) + 0.15::DOUBLE * CASE WHEN contains(low, '{PHRASE}') THEN 1 ELSE 0 END) * 1000000)::BIGINT AS relevance_ppm FROM r JOIN d USING (turnKey) WHERE rank <= 200)
SELECT turnKey, observedAt, relevance_ppm, row_number() OVER (ORDER BY relevance_ppm DESC, observedAt DESC NULLS LAST, turnKey) AS position FROM o"""


@define("r_search", "us tu", _SEARCH)
def r_search(spark: SparkSession, d: str) -> DataFrame:
    """Search over turns end to end: fields, chosen terms, weighted BM25, rerank and ties by time."""
    names = facts.capability_uses(spark, d).where("originScope = 'main'").select("turnKey", "capabilityName")
    return search.search_turns(facts.turns(spark, d), names, QUERY, PHRASE)


_MEMORY = "checkpoint store purge marker retention"
_WORDS = ", ".join(f"'{w}'" for w in _MEMORY.split())


def _memory_sql(name: str, where: str, k: int) -> str:
    return f"""{name}_p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents WHERE source = 'memory-entry' AND {where}) GROUP BY 1, 2), {name}_l AS (SELECT doc_id, sum(tf) AS len FROM {name}_p GROUP BY 1),
{name} AS (SELECT doc_id, score_ppm, row_number() OVER (ORDER BY score_ppm DESC, doc_id) AS rank FROM (SELECT doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg))) * 1000000)::BIGINT AS score_ppm
FROM {name}_p JOIN {name}_l USING (doc_id) JOIN (SELECT term, count(*) AS df FROM {name}_p GROUP BY 1) USING (term), (SELECT count(*) AS n, avg(len) AS avg FROM {name}_l) WHERE term IN ({_WORDS}) GROUP BY 1) ORDER BY score_ppm DESC, doc_id LIMIT {k})"""


@define("t_memory_search", "", f"WITH {_memory_sql('m', 'true', 20)} SELECT * FROM m")
def t_memory_search(spark: SparkSession, d: str) -> DataFrame:
    entries = table(spark, d, "documents").where("source = 'memory-entry'")
    return search.memory_search(entries, "doc_id", "text", _MEMORY, 20).withColumn("rank", F.col("rank").cast("bigint"))


@define("t_memory_recall", "", f"WITH {_memory_sql('a', 'project_key IS NOT NULL', 30)}, {_memory_sql('c', 'project_key IS NULL', 30)} SELECT doc_id, list, rank, row_number() OVER (ORDER BY rank, list, doc_id) AS position FROM (SELECT doc_id, 'approved' AS list, rank FROM a UNION ALL SELECT doc_id, 'candidate', rank FROM c) ORDER BY rank, list, doc_id LIMIT 10")
def t_memory_recall(spark: SparkSession, d: str) -> DataFrame:
    """Entries of a project stand for approved ones, the others for candidates."""
    entries = table(spark, d, "documents").where("source = 'memory-entry'")
    approved, candidates = (search.memory_search(entries.where(w), "doc_id", "text", _MEMORY, 30) for w in ("project_key is not null", "project_key is null"))
    return search.recall([("approved", approved), ("candidate", candidates)], "doc_id", 10)


@define("t_head_tail", "tu", f""", f AS (SELECT turnKey, 0 AS no, 'natural' AS field, regexp_extract_all(lower(problem), '[a-z0-9]+') AS a FROM tu UNION ALL SELECT turnKey, 1, 'code', regexp_extract_all(lower(problem), '{_CODE}') FROM tu),
u AS (SELECT turnKey, no, field, unnest(range(1, len(a) + 1)) AS place, len(a) AS size, unnest(a) AS item FROM f), h AS (SELECT *, row_number() OVER (PARTITION BY turnKey ORDER BY place, no) AS k FROM u),
t AS (SELECT *, row_number() OVER (PARTITION BY turnKey, k <= 6 ORDER BY size - place, no) AS z FROM h) SELECT turnKey, field, place::INT AS place, item FROM t WHERE k <= 6 OR z <= 4""")
def t_head_tail(spark: SparkSession, d: str) -> DataFrame:
    """The first six and last four terms of each problem, in turn from its words and its names."""
    low = F.lower("problem")
    fields = {f: F.regexp_extract_all(low, F.lit(p), 0) for f, p in search.FIELD_PATTERNS.items()}
    rows = facts.turns(spark, d).select("turnKey", F.explode(search.head_tail(fields, 6, 4)).alias("x"))
    return rows.select("turnKey", "x.field", "x.place", "x.item")


@define("set_overlap_sizes", "us", """, s AS (SELECT sessionKey, turnKey, list(DISTINCT capabilityKey) AS held, min((recordStart, contentIndex, ordinal, useKey)) AS first_at FROM us WHERE turnKey IS NOT NULL GROUP BY 1, 2),
l AS (SELECT *, lag(held) OVER (PARTITION BY sessionKey ORDER BY first_at) AS before FROM s) SELECT turnKey, sessionKey, len(list_intersect(held, before))::INT AS shared, len(list_distinct(list_concat(held, before)))::INT AS either FROM l WHERE before IS NOT NULL""")
def set_overlap_sizes(spark: SparkSession, d: str) -> DataFrame:
    """How many capabilities a turn shares with the one before it in its session, of how many both have."""
    held = facts.capability_uses(spark, d).where("turnKey is not null").groupBy("sessionKey", "turnKey").agg(F.collect_set("capabilityKey").alias("held"), F.min(F.struct(*an.SOURCE, "useKey")).alias("at"))
    both = held.withColumn("before", F.lag("held").over(Window.partitionBy("sessionKey").orderBy("at"))).where("before is not null")
    return both.select("turnKey", "sessionKey", F.size(F.array_intersect("held", "before")).alias("shared"), F.size(F.array_union("held", "before")).alias("either"))


@define("set_union_five", "ev us", "SELECT capabilityKey AS key FROM ev WHERE kind = 'capability-invocation' UNION SELECT capabilityKey FROM ev WHERE kind = 'capability-result' UNION SELECT capabilityKey FROM ev WHERE error IS NOT NULL AND capabilityKey IS NOT NULL UNION SELECT capabilityKey FROM us WHERE terminalState = 'failed' UNION SELECT capability_key FROM capability_retry_contributions WHERE capability_key IS NOT NULL")
def set_union_five(spark: SparkSession, d: str) -> DataFrame:
    e = facts.events(spark, d, "capabilityKey is not null").select("kind", "capabilityKey", F.col("error").isNotNull().alias("failed"))
    key = F.col("capabilityKey").alias("key")
    parts = [e.where("kind = 'capability-invocation'").select(key), e.where("kind = 'capability-result'").select(key), e.where("failed").select(key), facts.capability_uses(spark, d).where("terminalState = 'failed'").select(key)]
    parts.append(table(spark, d, "capability_retry_contributions").where("capability_key is not null").select(F.col("capability_key").alias("key")))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.distinct()


@define("agg_top_failed", "us", "SELECT sessionKey, capabilityKey, count(*) FILTER (terminalState = 'failed') AS failed FROM us GROUP BY 1, 2 ORDER BY failed DESC, sessionKey, capabilityKey LIMIT 20")
def agg_top_failed(spark: SparkSession, d: str) -> DataFrame:
    """The chains with most failures: a running top-k, so no task sorts them all."""
    counts = facts.capability_uses(spark, d).groupBy("sessionKey", "capabilityKey").agg(F.count_if(F.col("terminalState") == "failed").alias("failed"))
    return counts.orderBy(F.desc("failed"), "sessionKey", "capabilityKey").limit(20)


@define("r_solution_recall_full", "us tu", """, nx AS (SELECT a.useKey, arg_min(b.useKey, (b.recordStart, b.contentIndex, b.ordinal, b.useKey)) AS nextKey FROM us a JOIN us b ON a.sessionKey = b.sessionKey AND a.capabilityKey = b.capabilityKey AND b.terminalState = 'completed' AND (b.recordStart, b.contentIndex, b.ordinal, b.useKey) > (a.recordStart, a.contentIndex, a.ordinal, a.useKey) GROUP BY 1)
SELECT ev.eventKey, ev.turnKey, ev.kind AS "eventKind", ev.observedAt, tu.finalAnswer, nextKey FROM ev LEFT JOIN tu ON tu.turnKey = ev.turnKey LEFT JOIN nx ON nx.useKey = ev.eventKey
WHERE list_has_any(regexp_extract_all(lower(coalesce(ev.input, ev.output, '')), '[a-z0-9]+'), ['cursor', 'rollup']) ORDER BY ev.observedAt DESC NULLS LAST, ev.eventKey LIMIT 50""")
def r_solution_recall_full(spark: SparkSession, d: str) -> DataFrame:
    """The newest events whose text matches, with the answer of their turn and the next success in their chain."""
    from turnmill.operators import joins

    e = facts.events(spark, d, "input is not null or output is not null").select("eventKey", "turnKey", "kind", "observedAt", F.coalesce("input", "output").alias("text"))
    hits = e.join(search.ascii_hits(e, "eventKey", "text", ["cursor", "rollup"]), "eventKey", "left_semi").orderBy(F.col("observedAt").desc_nulls_last(), "eventKey").limit(50)
    u = joins.next_later(facts.capability_uses(spark, d), ["sessionKey", "capabilityKey"], [*an.SOURCE, "useKey"], F.col("terminalState") == "completed", F.col("useKey"), "nextKey").select(F.col("useKey").alias("eventKey"), "nextKey")
    out = hits.join(facts.turns(spark, d).select("turnKey", "finalAnswer"), "turnKey", "left").join(u, "eventKey", "left")
    return out.select("eventKey", "turnKey", F.col("kind").alias("eventKind"), "observedAt", "finalAnswer", "nextKey").orderBy(F.col("observedAt").desc_nulls_last(), "eventKey")


@define("r_capability_list", "us se", "SELECT capabilityKey, max(capabilityName) AS capabilityName, count(*) AS uses, " + ", ".join(f"count(*) FILTER (terminalState = '{s}') AS {s}" for s in an.STATES) + ", count(DISTINCT CASE WHEN confidence = 'strong' THEN us.sessionKey END) AS strong, count(DISTINCT CASE WHEN confidence = 'weak' THEN us.sessionKey END) AS weak FROM us LEFT JOIN se ON se.sessionKey = us.sessionKey WHERE capabilityKey > '4' GROUP BY 1 ORDER BY 1 LIMIT 10")
def r_capability_list(spark: SparkSession, d: str) -> DataFrame:
    """A page of the list of capabilities by key, with their states and the confidence of the sessions."""
    rows = an.capability_contexts(facts.capability_uses(spark, d).where("capabilityKey > '4'"), facts.sessions(spark, d))
    return rows.select("capabilityKey", "capabilityName", F.col("invocations").alias("uses"), *an.STATES, "strong", "weak").orderBy("capabilityKey").limit(10)


@define("t_times", "", "SELECT event_key, strftime(observed_at, '%Y-%m-%dT%H:%M:%S.') || lpad(((epoch_us(observed_at) // 1000) % 1000)::VARCHAR, 3, '0') || 'Z' AS canonical, epoch_us(observed_at) // 1000 * 1000 AS parsed FROM (SELECT DISTINCT event_key, observed_at FROM history_events WHERE observed_at IS NOT NULL AND event_key IS NOT NULL)")
def t_times(spark: SparkSession, d: str) -> DataFrame:
    """Times as text in milliseconds, and read back."""
    from turnmill.functions import text as tx

    rows = table(spark, d, "history_events").where("observed_at is not null and event_key is not null").select("event_key", "observed_at").distinct()
    return rows.select("event_key", tx.canonical_time(F.col("observed_at").cast("timestamp")).alias("canonical")).select("event_key", "canonical", tx.parsed_time(F.col("canonical")).alias("parsed"))


@define("t_utf8_prefix", "", "SELECT doc_id, max(left(text, i)) AS prefix FROM (SELECT doc_id, text, unnest(range(1, least(length(text), 64) + 1)) AS i FROM documents WHERE text IS NOT NULL) WHERE octet_length(encode(left(text, i))) <= 64 GROUP BY 1")
def t_utf8_prefix(spark: SparkSession, d: str) -> DataFrame:
    """The first 64 bytes of each text that cut no character."""
    from turnmill.functions import text as tx

    return table(spark, d, "documents").where("text is not null and text != ''").select("doc_id", tx.utf8_prefix(F.col("text"), 64).alias("prefix"))


@define("t_canonical_json", "us", """SELECT capabilityKey, '{"a":' || count(*) || ',"z":"' || max(capabilityName) || '"}' AS body FROM us GROUP BY 1""")
def t_canonical_json(spark: SparkSession, d: str) -> DataFrame:
    from turnmill.functions import text as tx

    rows = facts.capability_uses(spark, d).groupBy("capabilityKey").agg(F.count(F.lit(1)).alias("a"), F.max("capabilityName").alias("z"))
    return rows.select("capabilityKey", tx.canonical_json(F.concat(F.lit("{ "), F.lit('"z" : "'), F.col("z"), F.lit('", "a" :'), F.col("a").cast("string"), F.lit("}"))).alias("body"))
