"""DuckDB SQL for the queries that SQL can express, over whole tables."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x20\x09-\x0D]+"

NGRAM_JOIN = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE
    WHEN len(w) = 0 THEN []
    WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS shingles
  FROM words
), tokens AS (
  SELECT doc_id, len(shingles) AS n, unnest(shingles) AS token FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM tokens a JOIN tokens b ON a.token = b.token AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id
  HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))
), reached AS (
  SELECT doc_id AS node, doc_id AS other FROM sets
  UNION
  SELECT reached.node, links.b FROM reached JOIN links ON links.a = reached.other
)
SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles, r.component_id
FROM sets s JOIN (SELECT node, min(other) AS component_id FROM reached GROUP BY node) r ON r.node = s.doc_id
"""

QUALITY_RULES = rf"""
WITH texts AS (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents
), parts AS (
  SELECT row_id, doc_id, text, regexp_extract_all(text, '{_WORD}') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM texts
), windows AS (
  SELECT row_id, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6),
    lambda i: array_to_string(w[i:i + 7], ' '))) AS win
  FROM parts WHERE len(w) >= 8
), twice AS (
  SELECT row_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY row_id, win) > 1
), covered AS (
  SELECT row_id, count(DISTINCT place) AS n FROM (SELECT row_id, unnest(range(i, i + 8)) AS place FROM twice) GROUP BY row_id
), measures AS (
  SELECT p.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines,
    coalesce(c.n, 0) AS n_repeat_words,
    length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) AS letters,
    length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) AS capitals
  FROM parts p LEFT JOIN covered c USING (row_id)
), judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measures
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 100 * n_dup_lines > 30 * n_lines
    OR word_chars < 2 * n_words OR word_chars > 15 * n_words
    OR 100 * capitals > 50 * letters OR 100 * letters < 60 * word_chars) AS kept
FROM judged
"""

DECONTAMINATION = rf"""
WITH items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL
), item_windows AS (
  SELECT DISTINCT item, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS win
  FROM (SELECT item, w, least(13, len(w)) AS k FROM items WHERE len(w) > 0)
), docs AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), doc_windows AS (
  SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i,
    unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS win
  FROM docs JOIN (SELECT DISTINCT k FROM item_windows) ON len(w) >= k
), hits AS (
  SELECT DISTINCT d.doc_id, d.i, d.k, b.item FROM doc_windows d JOIN item_windows b ON b.k = d.k AND b.win = d.win
), places AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS place FROM hits) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(p.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(f.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(f.names, '')) AS items_sha256,
  coalesce(p.n_hit, 0) > 0 AND 20 * coalesce(p.n_hit, 0) >= len(d.w) AS contaminated
FROM docs d LEFT JOIN places p USING (doc_id) LEFT JOIN found f USING (doc_id)
"""
