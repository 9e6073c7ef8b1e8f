"""DuckDB SQL for the queries that SQL can express; the others are tested against brute force."""

from __future__ import annotations

OP10 = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), shared AS (
  SELECT k, max(doc_id) AS holder FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT keyed.*, shared.k IS NOT NULL AND doc_id <> holder AS gone
  FROM keyed LEFT JOIN shared ON keyed.k = shared.k
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

#: Of op1: a line's documents are counted by doc_id, and the limit is 5 or the logarithm of the host's documents.
OP1 = r"""
WITH d AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS w
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d WHERE len(ws) > 8)
), again AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (SELECT unnest(range(8)) AS k) GROUP BY doc_id
), lines AS (
  SELECT doc_id, host, line, lower(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS k,
         len(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words
  FROM (SELECT doc_id, host, unnest(string_split(t, chr(10))) AS line FROM d)
), dups AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE words > 0 GROUP BY doc_id
), hosts AS (
  SELECT host, count(DISTINCT doc_id) AS n FROM d GROUP BY host
), common AS (
  SELECT l.host, l.k FROM lines l JOIN hosts h ON l.host IS NOT DISTINCT FROM h.host
  WHERE l.words > 0 GROUP BY l.host, l.k, h.n HAVING count(DISTINCT l.doc_id) > greatest(5, log2(h.n))
), gone AS (
  SELECT l.doc_id, sum(l.words) AS n FROM lines l JOIN common c ON l.k = c.k AND l.host IS NOT DISTINCT FROM c.host WHERE l.words > 0 GROUP BY l.doc_id
), stats AS (
  SELECT d.doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(dups.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, len(ws) - coalesce(gone.n, 0) AS words_left
  FROM d LEFT JOIN dups ON dups.doc_id = d.doc_id LEFT JOIN covered ON covered.doc_id = d.doc_id LEFT JOIN gone ON gone.doc_id = d.doc_id
), judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM stats
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND words_left >= 20 AND words_left >= 0.3 * n_words AS kept, CAST(words_left AS BIGINT) AS words_left
FROM judged
"""

OP5 = r"""
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (
  SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g ON n.t = g.t
"""

_SAID = "'\\### Assistant: </turn> ok'"
_ESCAPED = "replace(replace(replace({}, '\\', '\\b'), '###', '\\h'), '</turn>', '\\t')"
OP7 = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', {_SAID} UNION ALL SELECT -7, 1, 'assistant', {_SAID}
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  CAST(sum(length('### ') + length(replace({_ESCAPED.format('role')}, ':', '\\c')) + length(': ') + length({_ESCAPED.format('text')}) + length('</turn>') + 1) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

ORACLES: dict[str, str] = {"op1_quality_rules": OP1, "op5_exact_dedup": OP5, "op7_chat": OP7, "op10_line_dedup": OP10}
