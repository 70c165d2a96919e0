"""From sessions to commits: evidence, classified edges, attribution of turns and traces around a node.

Evidence comes from hashes that results name, whole or abbreviated, from paths that a session changed and a commit holds, and from words that
a commit's summary shares with one session more than with any other. Each kind is one join; a pair of session and commit is then judged once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnmill.operators import joins

#: Edges of one trace at most.
TRACE_EDGES = 200
# Relation, strength and source by what is known of a pair, the strongest first.
CLASSES = {
    "hash": ("session-observed-commit", "direct", "observed-git-result"), "prefix": ("session-observed-commit", "observed", "unique-hash-prefix"), "window": ("session-correlates-commit", "observed", "ordered-exact-path-overlap"),
    "words": ("session-correlates-commit", "candidate", "unique-text-overlap"), "path": ("contextual-same-file", "contextual", "same-file-history"),
}


def classified(evidence: DataFrame) -> DataFrame:
    """evidence with relation, strength and source; rows without any are out.

    Columns: hash_observed, prefix_unique, in_window, words_unique (0 or 1), path_overlap and word_overlap (numbers); null counts as 0. Words need an overlap of two."""
    known = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    tests = {"hash": known("hash_observed"), "prefix": known("prefix_unique"), "window": known("path_overlap") & known("in_window"), "words": known("words_unique") & (F.coalesce("word_overlap", F.lit(0)) >= 2), "path": known("path_overlap")}
    kind = F.coalesce(*(F.when(t, k) for k, t in tests.items()))
    pick = lambda i: F.element_at(F.create_map(*(F.lit(x) for k, v in CLASSES.items() for x in (k, v[i]))), F.col("_class"))
    return evidence.withColumn("_class", kind).where("_class is not null").select("*", pick(0).alias("relation"), pick(1).alias("strength"), pick(2).alias("source")).drop("_class")


def session_commits(mentions: DataFrame, paths: DataFrame, words: DataFrame, commits: DataFrame, files: DataFrame, summaries: DataFrame, shortest: int = 7) -> DataFrame:
    """(repo, session, commit, relation, strength, source, paths, terms): one edge for each session and commit of which something is known.

    mentions: (repo, session, hash) of hashes, whole or abbreviated to `shortest` to 39 signs; paths: (repo, session, path, first_at, last_at) changed; words: (repo, session, term);
    commits: (repo, commit); files: (repo, commit, path, at); summaries: (repo, commit, term). Of the commits of a path only the nearest to the session's last change counts, one
    within its changes first. A prefix of several commits tells nothing. Repeated rows count once."""
    whole = mentions.select("repo", "session", F.col("hash").alias("commit")).distinct().join(commits.select("repo", "commit").distinct(), ["repo", "commit"], "left_semi").withColumn("hash_observed", F.lit(1))
    short = joins.prefix_unique(mentions.where(F.length("hash") < 40).select("repo", "session", "hash").distinct(), "repo", "hash", commits, "commit", shortest).select("repo", "session", "commit").distinct().withColumn("prefix_unique", F.lit(1))
    near = joins.nearest_in_time(paths.groupBy("repo", "path", "session").agg(F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at")), files.select("repo", "path", "at", "commit"), ["repo", "path"], "at", "first_at", "last_at", "commit")
    by_path = near.groupBy("repo", "session", "commit").agg(F.count(F.lit(1)).alias("path_overlap"), F.max("in_window").alias("in_window"))
    sep = "\u0000"
    term = F.concat_ws(sep, "repo", "term").alias("term")  # words are compared within a repository
    top = joins.unique_overlap(summaries.select(F.concat_ws(sep, "repo", "commit").alias("_c"), term), words.select(F.concat_ws(sep, "repo", "session").alias("_s"), term), "_c", "_s", "term")
    by_words = top.select(F.substring_index("_c", sep, 1).alias("repo"), F.substring_index("_s", sep, -1).alias("session"), F.substring_index("_c", sep, -1).alias("commit"), F.col("overlap").alias("word_overlap"), F.lit(1).alias("words_unique"))
    rows = None
    for part in (whole, short, by_path, by_words):
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    one = rows.groupBy("repo", "session", "commit").agg(*(F.max(c).alias(c) for c in ("hash_observed", "prefix_unique", "in_window", "words_unique", "path_overlap", "word_overlap")))
    return classified(one).select("repo", "session", "commit", "relation", "strength", "source", F.coalesce("path_overlap", F.lit(0)).alias("paths"), F.coalesce("word_overlap", F.lit(0)).alias("terms"))


def attribution(turns: DataFrame, edges: DataFrame, covered: DataFrame, turn: str = "turnKey", session: str = "session") -> DataFrame:
    """(turn, attribution): direct if an edge of its session observed a commit, observed if one only correlates, none if its project has a repository, else uncovered.

    turns: (turn, session, project); edges: (session, relation); covered: (project) with a repository that can be read."""
    rank = F.when(F.col("relation") == "session-observed-commit", 0).when(F.col("relation") == "session-correlates-commit", 1)
    best = edges.groupBy(session).agg(F.min(rank).alias("_r"))
    rows = turns.join(best, session, "left").join(covered.select("project").distinct().withColumn("_c", F.lit(1)), "project", "left")
    word = F.when(F.col("_r") == 0, "direct").when(F.col("_r") == 1, "observed").when(F.col("_c") == 1, "none").otherwise("uncovered")
    return rows.select(turn, word.alias("attribution"))


def _strength(allowed: list[str] | None) -> Column:
    return F.lit(True) if allowed is None else F.col("strength").isin(allowed)


def trace(edges: DataFrame, roots: DataFrame, direction: str = "both", strengths: list[str] | None = None, window: tuple[int, int] | None = None, most: int = TRACE_EDGES) -> DataFrame:
    """The edges at each root: (root_kind, root_key, direction, from_kind, from_key, to_kind, to_key, relation, strength, observed_at, position, more).

    edges: (from_kind, from_key, to_kind, to_key, relation, strength, observed_at); roots: (root_kind, root_key). Newest first, at most `most` for each root, and whether there are more.
    A window keeps edges with observed_at in [after, before); edges without time are in none."""
    from pyspark.sql import Window

    if direction not in ("in", "out", "both"):
        raise ValueError("direction is in, out or both")
    kept = edges.where(_strength(strengths))
    if window is not None:
        kept = kept.where((F.col("observed_at") >= window[0]) & (F.col("observed_at") < window[1]))
    rows = None
    for way, kind, key in (("out", "from_kind", "from_key"), ("in", "to_kind", "to_key")):
        if direction in (way, "both"):
            found = kept.join(roots.select(F.col("root_kind").alias(kind), F.col("root_key").alias(key)).distinct(), [kind, key], "left_semi").select(F.col(kind).alias("root_kind"), F.col(key).alias("root_key"), F.lit(way).alias("direction"), *edges.columns)
            rows = found if rows is None else rows.unionByName(found)
    line = Window.partitionBy("root_kind", "root_key").orderBy(F.col("observed_at").desc_nulls_last(), "direction", "relation", "from_kind", "from_key", "to_kind", "to_key")
    top = rows.withColumn("position", F.row_number().over(line).cast("bigint")).where(F.col("position") <= most + 1)
    more = F.max("position").over(Window.partitionBy("root_kind", "root_key")) > most
    return top.withColumn("more", more.cast("int")).where(F.col("position") <= most)


def replaced(state: DataFrame | None, delta: DataFrame, scope: str) -> DataFrame:
    """Rows after a delta that holds whole scopes (a repository with all of its commits, files, refs or intents): scopes of the delta are replaced, others stay."""
    return delta if state is None else state.join(delta.select(scope).distinct(), scope, "left_anti").unionByName(delta)
