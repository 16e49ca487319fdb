"""SQL of queries whose rows SQL can make: op3 by brute force over shared shingles, op8 with its exact binomial tails."""

from __future__ import annotations

from .quality import ALPHA, CUTOFFS, DELTA

WORD = r"[^\x20\x09-\x0D]+"

OP3_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)
), e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r AS (SELECT doc_id AS at, doc_id AS root FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.at)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.root) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.at = d.doc_id GROUP BY d.doc_id, n.n
"""

_RULES = ", ".join(f"('{rule}', {i}, {cut}::DOUBLE)" for rule, cuts in CUTOFFS.items() for i, cut in enumerate(cuts))
_A = ALPHA / len(CUTOFFS)

OP8_SQL = rf"""
WITH w AS (
  SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
), g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)
), f AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM g, range(3) t(o) WHERE c > 1 GROUP BY doc_id
), m AS (
  SELECT w.doc_id, lang, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(f.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN f ON f.doc_id = w.doc_id
), b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
), v AS (
  SELECT *, n_symbols / greatest(word_chars, 1) AS v_symbols, n_dup_lines / greatest(n_lines, 1) AS v_dup_lines, n_repeat_words / greatest(n_words, 1) AS v_repeats, word_chars / greatest(n_words, 1) AS v_word_length FROM b
), good AS (SELECT * FROM v WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1)
), rules(rule, step, cutoff) AS (VALUES {_RULES}
), k AS (
  SELECT lang, rule, step, cutoff, count(*) AS n, count(*) FILTER (CASE rule WHEN 'symbols' THEN v_symbols WHEN 'dup_lines' THEN v_dup_lines WHEN 'repeats' THEN v_repeats ELSE v_word_length END > cutoff) AS x
  FROM good, rules GROUP BY 1, 2, 3, 4
), p AS (
  SELECT *, CASE WHEN x >= n * {_A} THEN 1 ELSE list_sum([exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_A}) + (n - i) * ln(1 - {_A})) FOR i IN range(0, x + 1)]) END AS p,
    (SELECT count(*) FROM (SELECT DISTINCT lang FROM good)) AS strata FROM k
), o AS (SELECT *, bool_and(p <= {DELTA} / (strata * {len(CUTOFFS)})) OVER (PARTITION BY lang, rule ORDER BY step) AS ok FROM p
), c AS (SELECT lang, {', '.join(f"min(cutoff) FILTER (ok AND rule = '{r}') AS c_{r}" for r in CUTOFFS)} FROM o GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ({' OR '.join(f"coalesce(v_{r} > c_{r}, FALSE)" for r in CUTOFFS)}) AS kept
FROM v LEFT JOIN c ON v.lang IS NOT DISTINCT FROM c.lang
"""
