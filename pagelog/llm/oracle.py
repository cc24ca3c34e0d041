"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_MIX = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), src AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS s, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sized GROUP BY source
), w AS (SELECT *, CAST([5, 2, 1][CAST(rank % 3 AS INT) + 1] AS DOUBLE) AS weight FROM src),
lv AS (
  SELECT 0 AS step, CAST(0 AS DOUBLE) AS level, CAST(-1 AS BIGINT) AS stopped
  UNION ALL
  SELECT step + 1, ((SELECT sum(s) FROM w) - coalesce((SELECT sum(3 * s) FROM w WHERE 3 * s < weight * level), 0)) / (SELECT sum(weight) FROM w WHERE NOT 3 * s < weight * level),
         (SELECT count(*) FROM w WHERE 3 * s < weight * level)
  FROM lv WHERE stopped <> (SELECT count(*) FROM w WHERE 3 * s < weight * level)
), last AS (SELECT level FROM lv ORDER BY step DESC LIMIT 1),
goal AS (SELECT source, s AS source_size, least(3 * s, weight * (SELECT level FROM last)) AS target FROM w),
drawn AS (
  SELECT *, CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS v,
         CAST(CAST('0x' || substr(md5('mix:' || coalesce(source, '')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
  FROM sized
), ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, v, doc_id) - 1 AS r FROM drawn),
rated AS (
  SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
  FROM ranked d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source
), counted AS (SELECT *, floor(rate) + CASE WHEN floor(u + (r + 1) * (rate - floor(rate))) > floor(u + r * (rate - floor(rate))) THEN 1 ELSE 0 END AS copies FROM rated)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, CAST(size * copies AS BIGINT) AS taken FROM counted
"""

_QUALITY = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), win AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM w, unnest(range(1, len(ws) - 1)) AS u(i)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM rep, (VALUES (0), (1), (2)) v(j) GROUP BY doc_id),
base AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: len(x))), 0) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines,
         len(list_filter(ws, lambda x: regexp_matches(x, '[\p{L}\p{Nl}\p{No}]'))) AS lettered,
         len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) AS dotted, len(list_filter(ls, lambda x: regexp_matches(x, '^\s*(•|- |\* )'))) AS listed
  FROM w LEFT JOIN cov ON cov.doc_id = w.doc_id
), judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 10 * n_symbols <= n_words AND word_chars BETWEEN 3 * n_words AND 10 * n_words AND 10 * n_dup_lines <= 4 * n_lines
       AND 10 * lettered >= 7 * n_words AND 10 * dotted <= 3 * n_lines AND 10 * listed <= 9 * n_lines AS kept
FROM judged
"""

ORACLE: dict[str, str] = {
    "op8_quality": _QUALITY,
    "op5_mixing": _MIX,
    "op7_exact_dedup": f"""
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, {_LOW} AS t FROM documents)
""",
}
