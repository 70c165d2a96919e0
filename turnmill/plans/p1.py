"""Queries on the change feed of sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnmill.operators import changefeed
from turnmill.sources.tables import table


def found(spark: SparkSession, folder: str) -> DataFrame:
    return changefeed.held_turns(table(spark, folder, "session_commits"), table(spark, folder, "turn_upserts"))


_NUMBER = "TRY_CAST(CASE WHEN regexp_matches(trim({0}), '^[+]?[0-9]{{1,38}}$') THEN ltrim(trim({0}), '+') END AS DECIMAL(38,0))"

_FOUND = f"""
WITH RECURSIVE d AS (
  SELECT session_key, delta_id, delta_mode, coalesce(turn_keys, []) AS turn_keys, received_at,
    {_NUMBER.format("expected_generation")} AS e, {_NUMBER.format("generation")} AS g
  FROM session_commits WHERE session_key IS NOT NULL AND delta_id IS NOT NULL
), w AS (
  SELECT * FROM d WHERE e IS NOT NULL AND g IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY session_key, e ORDER BY received_at NULLS LAST, delta_id) = 1
), walk AS (
  SELECT session_key, delta_id, delta_mode, turn_keys, g, 0 AS rank, [e] AS path, [delta_id] AS done FROM w WHERE e = 0
  UNION ALL
  SELECT w.session_key, w.delta_id, w.delta_mode, w.turn_keys, w.g, walk.rank + 1, list_append(walk.path, w.e), list_append(walk.done, w.delta_id)
  FROM walk JOIN w ON w.session_key = walk.session_key AND w.e = walk.g AND NOT list_contains(walk.path, w.e) AND NOT list_contains(walk.done, w.delta_id)
), lowest AS (
  SELECT session_key, coalesce(max(CASE WHEN delta_mode = 'replace-session' THEN rank END), 0) AS floor FROM walk GROUP BY 1
), live AS (
  SELECT walk.* FROM walk JOIN lowest USING (session_key) WHERE rank >= floor
), changes AS (
  SELECT session_key, unnest(turn_keys) AS turn_key, rank, 0 AS phase, 0 AS upsert_no, delta_id, NULL::VARCHAR AS revision FROM live
  UNION ALL
  SELECT u.session_key, u.turn_key, rank, 1, u.upsert_no, u.delta_id, u.revision
  FROM turn_upserts u JOIN live ON live.session_key = u.session_key AND live.delta_id = u.delta_id
), last AS (
  SELECT * FROM changes WHERE turn_key IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY session_key, turn_key ORDER BY rank DESC, phase DESC, upsert_no DESC, delta_id DESC, revision DESC) = 1
)
SELECT session_key, turn_key, delta_id, revision FROM last WHERE phase = 1
"""

QUERIES = {"p1_found": found}
SQL = {"p1_found": _FOUND}
