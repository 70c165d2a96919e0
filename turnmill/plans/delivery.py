"""Queries on delivery edges. The tables don't say which repository belongs to a project nor which files a commit holds, so both are assigned by order: the
n-th project has the n-th repository (round and round), and a commit holds the known path that the first four signs of its id number, and mentions are beginnings of event keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnmill.operators import delivery
from turnmill.plans.reference import define
from turnmill.sources import facts
from turnmill.sources.tables import table


def _commits(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "git_commits").where("repository_id is not null and object_id is not null")
    return rows.groupBy(F.col("repository_id").alias("repo"), F.lower("object_id").alias("commit")).agg(F.max(facts.micros("committer_timestamp")).alias("at"), F.min("summary").alias("summary"))


def _numbered(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Distinct values with their number from 0: of a dictionary, so few."""
    return rows.where(F.col(column).isNotNull()).select(column).distinct().withColumn(name, F.row_number().over(Window.orderBy(column)) - 1)


def _repositories(spark: SparkSession, d: str, sessions: DataFrame) -> DataFrame:
    repos = _numbered(_commits(spark, d), "repo", "n")
    return _numbered(sessions, "projectKey", "n").withColumn("n", F.pmod("n", F.greatest(F.lit(1), repos.agg(F.count(F.lit(1)).cast("int").alias("c")).scalar()))).join(repos, "n").select("projectKey", "repo")


def _session_edges(spark: SparkSession, d: str) -> DataFrame:
    s = facts.sessions(spark, d)
    own = s.select("sessionKey", "projectKey").join(_repositories(spark, d, s), "projectKey").select("sessionKey", "repo")
    commits = _commits(spark, d)
    known = _numbered(facts.file_activities(spark, d), "path", "k")
    number = F.conv(F.substring("commit", 1, 4), 16, 10).cast("int")
    files = commits.withColumn("k", F.pmod(number, F.greatest(F.lit(1), known.agg(F.count(F.lit(1)).cast("int").alias("c")).scalar()))).join(known, "k").select("repo", "commit", "path", "at")
    paths = facts.file_activities(spark, d).where("observedAt is not null").groupBy("sessionKey", "path").agg(F.min("observedAt").alias("first_at"), F.max("observedAt").alias("last_at")).join(own, "sessionKey").select("repo", F.col("sessionKey").alias("session"), "path", "first_at", "last_at")
    e = facts.events(spark, d, "kind in ('turn-lifecycle', 'capability-result')").select("sessionKey", "eventKey", "kind").join(own, "sessionKey")
    short = e.where("kind = 'capability-result'").select("repo", F.col("sessionKey").alias("session"), F.substring("eventKey", 1, 2).alias("hash"))
    whole = e.where("kind = 'turn-lifecycle'").withColumn("p", F.substring("eventKey", 1, 4)).join(commits.select("repo", "commit", F.substring("commit", 1, 4).alias("p")), ["repo", "p"]).select("repo", F.col("sessionKey").alias("session"), F.col("commit").alias("hash"))
    term = lambda c: F.explode(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{5,}"), 0))).alias("term")
    words = facts.turns(spark, d).join(own, "sessionKey").select("repo", F.col("sessionKey").alias("session"), term(F.col("problem")))
    return delivery.session_commits(short.unionByName(whole), paths, words, commits, files, commits.select("repo", "commit", term(F.col("summary"))), shortest=2)


_EDGES = r""", cm AS (SELECT repository_id AS repo, lower(object_id) AS commit, max(epoch_us(committer_timestamp)) AS at_us, min(summary) AS summary FROM git_commits WHERE repository_id IS NOT NULL AND object_id IS NOT NULL GROUP BY 1, 2),
rn AS (SELECT repo, row_number() OVER (ORDER BY repo) - 1 AS n FROM (SELECT DISTINCT repo FROM cm)), pn AS (SELECT projectKey, row_number() OVER (ORDER BY projectKey) - 1 AS n FROM (SELECT DISTINCT projectKey FROM se WHERE projectKey IS NOT NULL)),
rp AS (SELECT projectKey, repo FROM pn JOIN rn ON pn.n % (SELECT count(*) FROM rn) = rn.n), ow AS (SELECT sessionKey, repo FROM se JOIN rp USING (projectKey)),
kn AS (SELECT path, row_number() OVER (ORDER BY path) - 1 AS k FROM (SELECT DISTINCT path FROM fa)), fi AS (SELECT repo, commit, path, at_us FROM cm JOIN kn ON ('0x' || left(commit, 4))::INT % (SELECT count(*) FROM kn) = kn.k),
pa AS (SELECT repo, sessionKey AS session, path, min(observedAt) AS first_at, max(observedAt) AS last_at FROM fa JOIN ow USING (sessionKey) WHERE observedAt IS NOT NULL GROUP BY 1, 2, 3),
nr AS (SELECT repo, session, path, commit, CASE WHEN at_us BETWEEN first_at AND last_at THEN 1 ELSE 0 END AS in_window FROM pa JOIN fi USING (repo, path) WHERE at_us IS NOT NULL QUALIFY row_number() OVER (PARTITION BY repo, session, path ORDER BY in_window DESC, abs(at_us - last_at), commit) = 1),
bp AS (SELECT repo, session, commit, count(*) AS paths, max(in_window) AS in_window FROM nr GROUP BY 1, 2, 3),
wh AS (SELECT DISTINCT ow.repo, ow.sessionKey AS session, commit FROM ev JOIN ow USING (sessionKey) JOIN cm ON cm.repo = ow.repo AND left(cm.commit, 4) = left(eventKey, 4) WHERE kind = 'turn-lifecycle'),
sh AS (SELECT DISTINCT m.repo, m.session, p.commit FROM (SELECT DISTINCT ow.repo, ow.sessionKey AS session, left(eventKey, 2) AS hash FROM ev JOIN ow USING (sessionKey) WHERE kind = 'capability-result') m
  JOIN (SELECT repo, left(commit, 2) AS hash, min(commit) AS commit FROM cm GROUP BY 1, 2 HAVING count(*) = 1) p ON p.repo = m.repo AND p.hash = m.hash),
ws AS (SELECT DISTINCT repo, sessionKey AS session, unnest(regexp_extract_all(lower(problem), '[a-z]{5,}')) AS term FROM tu JOIN ow USING (sessionKey)), wc AS (SELECT DISTINCT repo, commit, unnest(regexp_extract_all(lower(summary), '[a-z]{5,}')) AS term FROM cm),
po_ AS (SELECT repo, commit, session, count(*) AS overlap FROM wc JOIN ws USING (repo, term) GROUP BY 1, 2, 3 HAVING count(*) >= 2), pm AS (SELECT repo, commit, max(overlap) AS overlap FROM po_ GROUP BY 1, 2),
bw AS (SELECT repo, commit, min(session) AS session, overlap AS terms FROM po_ JOIN pm USING (repo, commit, overlap) GROUP BY repo, commit, overlap HAVING count(*) = 1),
al AS (SELECT repo, session, commit, max(h) AS h, max(s) AS s, max(paths) AS paths, max(in_window) AS in_window, max(terms) AS terms FROM (
  SELECT repo, session, commit, 1 AS h, 0 AS s, 0 AS paths, 0 AS in_window, 0 AS terms FROM wh UNION ALL SELECT repo, session, commit, 0, 1, 0, 0, 0 FROM sh UNION ALL SELECT repo, session, commit, 0, 0, paths, in_window, 0 FROM bp UNION ALL SELECT repo, session, commit, 0, 0, 0, 0, terms FROM bw) GROUP BY 1, 2, 3),
ce AS (SELECT repo, session, commit, CASE WHEN h > 0 OR s > 0 THEN 'session-observed-commit' WHEN (paths > 0 AND in_window > 0) OR terms >= 2 THEN 'session-correlates-commit' ELSE 'contextual-same-file' END AS relation,
  CASE WHEN h > 0 THEN 'direct' WHEN s > 0 OR (paths > 0 AND in_window > 0) THEN 'observed' WHEN terms >= 2 THEN 'candidate' ELSE 'contextual' END AS strength,
  CASE WHEN h > 0 THEN 'observed-git-result' WHEN s > 0 THEN 'unique-hash-prefix' WHEN paths > 0 AND in_window > 0 THEN 'ordered-exact-path-overlap' WHEN terms >= 2 THEN 'unique-text-overlap' ELSE 'same-file-history' END AS source, paths, terms FROM al)
"""


@define("r_edge_classification", "ev se tu fa", _EDGES + "SELECT * FROM ce")
def r_edge_classification(spark: SparkSession, d: str) -> DataFrame:
    return _session_edges(spark, d)


@define("r_turn_attribution", "ev se tu fa", _EDGES + """, be AS (SELECT session, min(CASE relation WHEN 'session-observed-commit' THEN 0 WHEN 'session-correlates-commit' THEN 1 END) AS r FROM ce GROUP BY 1)
SELECT turnKey, CASE WHEN r = 0 THEN 'direct' WHEN r = 1 THEN 'observed' WHEN rp.projectKey IS NOT NULL THEN 'none' ELSE 'uncovered' END AS attribution FROM tu LEFT JOIN se USING (sessionKey) LEFT JOIN be ON be.session = tu.sessionKey LEFT JOIN rp ON rp.projectKey = se.projectKey""")
def r_turn_attribution(spark: SparkSession, d: str) -> DataFrame:
    s = facts.sessions(spark, d)
    turns = facts.turns(spark, d).select("turnKey", F.col("sessionKey").alias("session")).join(s.select(F.col("sessionKey").alias("session"), F.col("projectKey").alias("project")), "session", "left")
    return delivery.attribution(turns, _session_edges(spark, d), _repositories(spark, d, s).select(F.col("projectKey").alias("project")))


_GRAPH = """, gr AS (SELECT 'session' AS from_kind, session AS from_key, 'commit' AS to_kind, commit AS to_key, relation, strength, cm.at_us AS observed_at FROM ce JOIN cm USING (repo, commit)
UNION ALL SELECT 'turn', turnKey, 'session', sessionKey, 'turn-of-session', 'direct', observedAt FROM tu UNION ALL SELECT 'commit', fi.commit, 'file', fi.path, 'commit-changes-file', 'direct', fi.at_us FROM fi UNION ALL SELECT 'repository', repo, 'commit', commit, 'repository-holds-commit', 'direct', at_us FROM cm)"""


def _graph(spark: SparkSession, d: str) -> DataFrame:
    edge = lambda a, ak, b, bk, relation, strength, at: [F.lit(a).alias("from_kind"), ak.alias("from_key"), F.lit(b).alias("to_kind"), bk.alias("to_key"), relation.alias("relation"), strength.alias("strength"), at.alias("observed_at")]
    c, lit, direct = F.col, F.lit, F.lit("direct")
    commits = _commits(spark, d)
    known = _numbered(facts.file_activities(spark, d), "path", "k")
    files = commits.withColumn("k", F.pmod(F.conv(F.substring("commit", 1, 4), 16, 10).cast("int"), F.greatest(F.lit(1), known.agg(F.count(F.lit(1)).cast("int").alias("c")).scalar()))).join(known, "k")
    rows = _session_edges(spark, d).join(commits, ["repo", "commit"]).select(*edge("session", c("session"), "commit", c("commit"), c("relation"), c("strength"), c("at")))
    rows = rows.unionByName(facts.turns(spark, d).select(*edge("turn", c("turnKey"), "session", c("sessionKey"), lit("turn-of-session"), direct, c("observedAt"))))
    rows = rows.unionByName(files.select(*edge("commit", c("commit"), "file", c("path"), lit("commit-changes-file"), direct, c("at"))))
    return rows.unionByName(commits.select(*edge("repository", c("repo"), "commit", c("commit"), lit("repository-holds-commit"), direct, c("at"))))


@define("r_delivery_trace", "ev se tu fa", _EDGES + _GRAPH + """, ro AS (SELECT 'session' AS root_kind, sessionKey AS root_key FROM se WHERE confidence = 'strong' UNION ALL SELECT 'file', 'lib/cursor.py'),
x AS (SELECT root_kind, root_key, 'out' AS direction, gr.* FROM gr JOIN ro ON from_kind = root_kind AND from_key = root_key UNION ALL SELECT root_kind, root_key, 'in', gr.* FROM gr JOIN ro ON to_kind = root_kind AND to_key = root_key),
n AS (SELECT *, row_number() OVER (PARTITION BY root_kind, root_key ORDER BY observed_at DESC NULLS LAST, direction, relation, from_kind, from_key, to_kind, to_key) AS position, count(*) OVER (PARTITION BY root_kind, root_key) AS k FROM x WHERE strength IN ('direct', 'observed'))
SELECT root_kind, root_key, direction, from_kind, from_key, to_kind, to_key, relation, strength, observed_at, position, CASE WHEN k > 20 THEN 1 ELSE 0 END AS more FROM n WHERE position <= 20""")
def r_delivery_trace(spark: SparkSession, d: str) -> DataFrame:
    """What is directly known around the sessions with strong copies and around one file."""
    roots = facts.sessions(spark, d).where("confidence = 'strong'").select(F.lit("session").alias("root_kind"), F.col("sessionKey").alias("root_key")).unionByName(spark.createDataFrame([("file", "lib/cursor.py")], "root_kind string, root_key string"))
    return delivery.trace(_graph(spark, d), roots, "both", ["direct", "observed"], most=20)


@define("r_extraction_score_edges", "fc se tu fa", _EDGES + """, e AS (SELECT session AS sessionKey, count(*) FILTER (strength = 'direct') AS direct, count(*) FILTER (strength = 'observed') AS observed FROM ce GROUP BY 1)
SELECT sessionKey, turns, uses, recovered, conclusive, coalesce(direct, 0) AS direct, coalesce(observed, 0) AS observed, 40 * coalesce(direct, 0) + 25 * coalesce(observed, 0) + 15 * recovered + least(10, (10 * uses + turns // 2) // turns) + 5 * conclusive AS score
FROM (SELECT t.sessionKey, t.turns, t.conclusive, coalesce(u.uses, 0) AS uses, coalesce(r.recovered, 0) AS recovered FROM (SELECT sessionKey, count(*) AS turns, max(CASE WHEN finalAnswer IS NOT NULL THEN 1 ELSE 0 END) AS conclusive FROM tu WHERE visibility = 'active' GROUP BY 1 HAVING count(*) >= 3) t
LEFT JOIN (SELECT sessionKey, count(*) AS uses FROM us GROUP BY 1) u USING (sessionKey) LEFT JOIN (SELECT sessionKey, count(*) AS recovered FROM fc WHERE status = 'resolved' GROUP BY 1) r USING (sessionKey)) LEFT JOIN e USING (sessionKey)""")
def r_extraction_score_edges(spark: SparkSession, d: str) -> DataFrame:
    """The score of sessions with what is known of their commits in it."""
    from turnmill.operators import analyses as an

    u = facts.capability_uses(spark, d)
    base = an.extraction_scores(facts.turns(spark, d), u, an.failure_chains(u))
    e = _session_edges(spark, d).groupBy(F.col("session").alias("sessionKey")).agg(F.count_if(F.col("strength") == "direct").alias("direct"), F.count_if(F.col("strength") == "observed").alias("observed"))
    n = lambda c: F.coalesce(c, F.lit(0))
    return base.join(e, "sessionKey", "left").select("sessionKey", "turns", "uses", "recovered", "conclusive", n("direct").alias("direct"), n("observed").alias("observed"), (40 * n("direct") + 25 * n("observed") + F.col("score")).alias("score"))


@define("s_repository_replace", "", "SELECT repository_id, ref_name, object_id FROM (SELECT DISTINCT repository_id, ref_name, object_id FROM repository_refs WHERE repository_id <= (SELECT max(repository_id) FROM (SELECT repository_id FROM repository_refs ORDER BY repository_id LIMIT 10)) AND ref_name NOT LIKE 'refs/tags/%' UNION SELECT DISTINCT repository_id, ref_name, object_id FROM repository_refs WHERE repository_id > (SELECT max(repository_id) FROM (SELECT repository_id FROM repository_refs ORDER BY repository_id LIMIT 10)))")
def s_repository_replace(spark: SparkSession, d: str) -> DataFrame:
    """The first repositories come again without their tags and replace what was held of them."""
    refs = table(spark, d, "repository_refs").select("repository_id", "ref_name", "object_id").distinct()
    last = table(spark, d, "repository_refs").select("repository_id").orderBy("repository_id").limit(10).agg(F.max("repository_id").alias("m")).scalar()
    return delivery.replaced(refs, refs.where((F.col("repository_id") <= last) & ~F.col("ref_name").startswith("refs/tags/")), "repository_id")
