"""Queries on the commit graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.operators import gitgraph
from turnmill.sources.tables import table


def found(spark: SparkSession, folder: str) -> DataFrame:
    return gitgraph.commit_forest(table(spark, folder, "git_commits"), table(spark, folder, "repository_refs"))


def hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    """Roots, depths and counts of descendants; the index behind them depends on how commits fall into chunks, so it isn't shown."""
    return gitgraph.commit_hierarchy(table(spark, folder, "git_commits")).drop("anchor_object_id", "segment")


def paths(spark: SparkSession, folder: str) -> DataFrame:
    """Paths as ids joined by slashes, root first."""
    return gitgraph.commit_paths(table(spark, folder, "git_commits")).withColumn("path", F.concat_ws("/", "path"))


def descendants(spark: SparkSession, folder: str) -> DataFrame:
    return gitgraph.commit_descendants(table(spark, folder, "git_commits"))


QUERIES = {"p4_found": found, "p4_hierarchy": hierarchy, "p4_paths": paths, "p4_descendants": descendants}
#: Each commit with the parent it hangs on: up(r, o, p).
_UP = """
WITH RECURSIVE n AS (
  SELECT repository_id AS r, lower(object_id) AS o,
    list_filter(coalesce(TRY_CAST(from_json(CASE WHEN trim(parent_object_ids_json) = '' THEN '[]' ELSE lower(parent_object_ids_json) END, '["VARCHAR"]') AS VARCHAR[]), []), lambda x: x IS NOT NULL AND trim(x) <> '') AS ps
  FROM git_commits WHERE repository_id IS NOT NULL AND object_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY repository_id, lower(object_id) ORDER BY committer_timestamp DESC NULLS LAST) = 1
), up AS (
  SELECT n.r, n.o, p.o AS p FROM n LEFT JOIN n p ON p.r = n.r AND p.o = n.ps[1]
)"""
_FOUND = _UP + """, tree AS (
  SELECT r, o, o AS root, 0 AS depth FROM up WHERE p IS NULL
  UNION ALL
  SELECT up.r, up.o, tree.root, tree.depth + 1 FROM tree JOIN up ON up.r = tree.r AND up.p = tree.o
), lost AS (
  SELECT up.* FROM up ANTI JOIN tree ON tree.r = up.r AND tree.o = up.o
), walk AS (
  SELECT r, o, p AS a FROM lost
  UNION
  SELECT walk.r, walk.o, lost.p FROM walk JOIN lost ON lost.r = walk.r AND lost.o = walk.a
), ring AS (
  SELECT r, o FROM walk WHERE o = a
), roots AS (
  SELECT walk.r, walk.o, min(walk.a) AS root FROM walk JOIN ring ON ring.r = walk.r AND ring.o = walk.a GROUP BY 1, 2
), links AS (
  SELECT DISTINCT r, o, unnest(ps) AS p FROM n
), hit AS (
  SELECT DISTINCT n.r, n.o FROM repository_refs f JOIN n ON n.r = f.repository_id AND n.o = lower(f.object_id)
  UNION
  SELECT n.r, n.o FROM hit JOIN links ON links.r = hit.r AND links.o = hit.o JOIN n ON n.r = links.r AND n.o = links.p
), placed AS (
  SELECT r, o, root, depth FROM tree UNION ALL SELECT r, o, root, -1 FROM roots
)
SELECT placed.r AS repository_id, placed.o AS object_id, root AS root_object_id, depth::BIGINT AS tree_depth, CASE WHEN hit.o IS NULL THEN 0 ELSE 1 END::BIGINT AS is_reachable
FROM placed LEFT JOIN hit ON hit.r = placed.r AND hit.o = placed.o
"""

#: The way up from each commit, until an id would come again: path(r, o, path, cyclic), the commit last.
_PATH = _UP + """, way AS (
  SELECT r, o, p AS nxt, [o] AS path FROM up
  UNION ALL
  SELECT way.r, way.o, up.p, list_prepend(up.o, way.path) FROM way JOIN up ON up.r = way.r AND up.o = way.nxt WHERE NOT list_contains(way.path, up.o)
), path AS (
  SELECT r, o, path, nxt IS NOT NULL AS cyclic FROM way WHERE nxt IS NULL OR list_contains(path, nxt)
)"""
_PATHS = _PATH + " SELECT r AS repository_id, o AS object_id, array_to_string(path, '/') AS path FROM path"
_DESCENDANTS = _PATH + ", d AS (SELECT r, o, unnest(path) AS a FROM path) SELECT r AS repository_id, a AS object_id, o AS descendant_object_id FROM d WHERE a <> o"
_HIERARCHY = (
    _PATH
    + """, d AS (SELECT r, unnest(path) AS a FROM path WHERE NOT cyclic), n_below AS (SELECT r, a, count(*) - 1 AS below FROM d GROUP BY 1, 2),
on_ring AS (SELECT path.r, path.o FROM path JOIN up ON up.r = path.r AND up.o = path.path[1] AND up.p = path.o WHERE cyclic),
on_cycle AS (SELECT w.r, w.o, min(w.a) AS root FROM (SELECT r, o, unnest(path) AS a FROM path WHERE cyclic) w JOIN on_ring ON on_ring.r = w.r AND on_ring.o = w.a GROUP BY 1, 2)
SELECT p.r AS repository_id, p.o AS object_id, CASE WHEN p.cyclic THEN on_cycle.root ELSE p.path[1] END AS root_object_id, (CASE WHEN p.cyclic THEN -1 ELSE len(p.path) - 1 END)::BIGINT AS tree_depth,
  CASE WHEN NOT p.cyclic THEN n_below.below END AS descendants
FROM path p LEFT JOIN n_below ON n_below.r = p.r AND n_below.a = p.o LEFT JOIN on_cycle ON on_cycle.r = p.r AND on_cycle.o = p.o"""
)

SQL = {"p4_found": _FOUND, "p4_hierarchy": _HIERARCHY, "p4_paths": _PATHS, "p4_descendants": _DESCENDANTS}
