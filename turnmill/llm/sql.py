"""SQL of the queries of this subpackage that SQL can express."""

_VOLATILE = [
    (r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "~"), (r"(?i)(req(?:uest)?[-_]?id[\x22'']{0,1}\s{0,3}[:=]\s{0,3}[\x22'']{0,1})[A-Za-z0-9_.-]+", r"\1~"), (r"(?i)\breq[-_][0-9a-z]{6,}\b", "~"),
    (r"""(?:/var|/private)?/tmp/[^\s"''|;,)]+""", "~"), (r"\btmp[._-]?[A-Za-z0-9]{6,}(?:\.\w+)?\b", "~"), (r"\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?", "~"), (r"\b\d{1,2}:\d{2}:\d{2}(?:[.,]\d+)?\b", "~"),
    (r"(^|[^\d+./-])1[4-9]\d{8}(?:\d{3}){0,3}($|[^\d./-])", r"\1~\2"), (r"(?i)(\bpid[\s:=#]{1,3})\d+", r"\1~"), (r"(?i)(\b(?:attempt|retry|try)[\s:=#]{1,3})\d+(?:\s?(?:/|of)\s?\d+)?", r"\1~"), (r"[\s\p{Z}]+", ""),
]
_settled = "input_text"
for _pattern, _mark in _VOLATILE:
    _settled = f"regexp_replace({_settled}, '{_pattern}', '{_mark}', 'g')"

P3 = f"""
WITH e AS (
  SELECT DISTINCT session_key, event_key, record_start_offset AS a, content_index AS b, event_ordinal AS c, capability_key, input_fingerprint, {_settled} AS settled
  FROM history_events WHERE event_kind = 'capability-invocation' AND session_key IS NOT NULL AND event_key IS NOT NULL
), m AS (
  SELECT *, CASE WHEN capability_key = lag(capability_key) OVER w AND (input_fingerprint = lag(input_fingerprint) OVER w OR settled = lag(settled) OVER w) THEN 0 ELSE 1 END AS fresh
  FROM e WINDOW w AS (PARTITION BY session_key ORDER BY a, b, c, event_key)
), g AS (
  SELECT *, sum(fresh) OVER (PARTITION BY session_key ORDER BY a, b, c, event_key) AS run, row_number() OVER (PARTITION BY session_key ORDER BY a, b, c, event_key) AS n FROM m
)
SELECT session_key, arg_min(event_key, n) AS first_event_key, arg_max(event_key, n) AS last_event_key, count(*) AS run_length FROM g GROUP BY session_key, run HAVING count(*) > 1
"""

P5 = r"""
WITH e AS (
  SELECT DISTINCT session_key, seq_no, entry_id, coalesce(lower(trim(entry_kind)) = 'message', false) AS is_message, lower(regexp_replace(coalesce(speaker_role, ''), '^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$', '', 'g')) AS said,
    regexp_matches(coalesce(markdown, ''), '[^\s\p{Z}\p{Cc}\p{Cf}]') AS visible
  FROM session_messages WHERE session_key IS NOT NULL
), r AS (
  SELECT *, CASE WHEN said IN ('user', 'human') THEN 'u' WHEN said IN ('assistant', 'agent', 'ai', 'model', 'bot') THEN 'a' WHEN said = 'system' THEN 's' ELSE '?' END AS role FROM e
), whole AS (
  SELECT session_key FROM r GROUP BY 1
  HAVING count(*) FILTER (seq_no IS NULL) = 0 AND min(seq_no) = 0 AND max(seq_no) = count(DISTINCT seq_no) - 1 AND count(DISTINCT (seq_no, entry_id)) = count(DISTINCT seq_no) AND count(*) FILTER (is_message AND role = '?') = 0
), m AS (
  SELECT DISTINCT session_key, seq_no, entry_id, role FROM r SEMI JOIN whole USING (session_key) WHERE is_message AND visible
), t AS (
  SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after FROM m WHERE role <> 's' WINDOW w AS (PARTITION BY session_key ORDER BY seq_no)
), good AS (
  SELECT session_key FROM t GROUP BY 1 HAVING count(*) FILTER (before IS NULL AND role <> 'u') = 0 AND count(*) FILTER (role = 'u' AND after IS DISTINCT FROM 'a') = 0
)
SELECT session_key, row_number() OVER (PARTITION BY session_key ORDER BY seq_no) AS msg_index, entry_id FROM m SEMI JOIN good USING (session_key)
"""

_P5_TEXTS = """, texts AS (
  SELECT session_key, seq_no, coalesce(entry_id, '') AS entry_id, markdown, created_at FROM session_messages WHERE session_key IS NOT NULL AND lower(trim(entry_kind)) = 'message'
  QUALIFY row_number() OVER (PARTITION BY session_key, seq_no, coalesce(entry_id, '') ORDER BY created_at NULLS FIRST, markdown NULLS FIRST) = 1
), numbered AS (
  SELECT session_key, seq_no, row_number() OVER (PARTITION BY session_key ORDER BY seq_no) AS msg_index, entry_id, CASE role WHEN 'u' THEN 'user' WHEN 'a' THEN 'assistant' ELSE 'system' END AS role FROM m SEMI JOIN good USING (session_key)
)
SELECT n.session_key, msg_index, role, coalesce(n.entry_id, '') AS entry_id, markdown, epoch_us(created_at) AS created_us FROM numbered n JOIN texts t ON t.session_key = n.session_key AND t.seq_no = n.seq_no AND t.entry_id = coalesce(n.entry_id, '')
"""
P5_CONVERSATIONS = P5[: P5.rindex("SELECT session_key, row_number()")].rstrip() + _P5_TEXTS

_WORDS = r"regexp_extract_all(lower(regexp_replace({0}, '<!--.*?-->|</?[A-Za-z][^<>\n]{{0,200}}>|&(?:[A-Za-z]{{2,8}}|#[0-9]{{1,6}});', ' ', 'g')), '[\p{{L}}\p{{N}}]+')"

P6 = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents WHERE doc_id IS NOT NULL), i AS (SELECT item_id, {_WORDS.format("passage")} AS w FROM eval_items WHERE item_id IS NOT NULL),
a AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 11], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d)), b AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 11], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i))
SELECT DISTINCT doc_id, item_id FROM a JOIN b USING (s)
"""

SQL = {"p3_found": P3, "p5_found": P5, "p5_conversations": P5_CONVERSATIONS, "p6_found": P6}
