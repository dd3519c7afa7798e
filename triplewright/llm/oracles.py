"""SQL for DuckDB that gives the rows of those queries that SQL can express on whole tables."""

from __future__ import annotations

from .license_scan import TEMPLATES, THRESHOLD, bigrams, normalised
from .quality_rules import BOILERPLATE, ENDS, MAX_REPEAT_PERCENT, MIN_KEPT_PERCENT, MIN_WORDS, NAVIGATION, SYMBOLS

SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
WORD = r"[^\x20\x09-\x0D]+"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


TOP_K = """
WITH c AS (SELECT vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
p AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id,
             list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: CASE WHEN (z[1] > 0) <> (z[2] > 0) THEN 1 ELSE 0 END))::INTEGER AS distance
      FROM c a JOIN c b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, rank::INTEGER AS rank, neighbor_id, distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM p) WHERE rank <= 10
"""

LINES = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
t AS (SELECT *, trim(line, {SPACES}) AS body FROM l),
s AS (SELECT body FROM t WHERE body <> '' GROUP BY body HAVING count(DISTINCT coalesce(source, '')) >= 10),
m AS (SELECT t.*, s.body IS NOT NULL AND row_number() OVER (PARTITION BY t.body ORDER BY t.doc_id, t.pos) > 1 AS gone FROM t LEFT JOIN s USING (body))
SELECT doc_id, count_if(body <> '')::BIGINT AS n_lines, count_if(gone)::BIGINT AS n_removed,
       md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_md5
FROM m GROUP BY doc_id
"""

_templates = sorted((name, bigrams(normalised(text))) for name, text in TEMPLATES)
_rows = ", ".join(f"({quoted(name)}, [{', '.join(map(quoted, grams))}])" for name, grams in _templates)
LICENSES = f"""
WITH k(license, g) AS (VALUES {_rows}),
u AS (SELECT doc_id, 'line' AS unit, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS unit_no FROM documents
      UNION ALL SELECT doc_id, 'text', text, 0 FROM documents WHERE contains(text, chr(10))
      UNION ALL SELECT doc_id, 'paragraph', body, unit_no FROM (
        SELECT doc_id, unnest(regexp_split_to_array(text, '\\n[^\\p{{L}}\\p{{N}}\\n]*\\n')) AS body, generate_subscripts(regexp_split_to_array(text, '\\n[^\\p{{L}}\\p{{N}}\\n]*\\n'), 1) - 1 AS unit_no FROM documents) WHERE contains(body, chr(10))
      UNION ALL SELECT doc_id, 'sentence', unnest(s), generate_subscripts(s, 1) - 1 FROM (
        SELECT doc_id, flatten(list_filter(list_transform(string_split(text, chr(10)), lambda l: string_split(regexp_replace(l, '([.!?])[\\x20\\x09-\\x0D]+', '\\1' || chr(1), 'g'), chr(1))), lambda p: len(p) > 1)) AS s FROM documents)),
w AS (SELECT doc_id, unit, unit_no, regexp_extract_all(lower(body), '[\\p{{L}}\\p{{N}}]+') AS w FROM u WHERE body IS NOT NULL),
b AS (SELECT doc_id, unit, unit_no, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w WHERE len(w) >= 2),
x AS (SELECT doc_id, unit, unit_no, license, 2.0::DOUBLE * len(list_intersect(b.g, k.g)) / (len(b.g) + len(k.g)) AS dice FROM b JOIN k ON len(b.g) <= 3 * len(k.g))
SELECT doc_id, unit, unit_no::INTEGER AS unit_no, license, dice
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, unit, unit_no ORDER BY dice DESC, license) AS r FROM x WHERE dice >= {THRESHOLD}) WHERE r = 1
"""

_phrases = "|".join("\\Q" + p + "\\E" for p in NAVIGATION + BOILERPLATE)
_symbol_class = "[" + "".join("\\" + c for c in SYMBOLS) + "]"
RULES = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
t AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM t),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
b AS (SELECT doc_id, line, translate(line, {SPACES}, '') AS body FROM l),
f AS (SELECT *, length(body) AS size, length(body) - length(regexp_replace(body, '{_symbol_class}', '', 'g')) AS symbols, len(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+')) AS n FROM b WHERE body <> ''),
v AS (SELECT *, (symbols >= 3 AND symbols * 20 >= size) OR NOT regexp_matches(body, '[\\p{{L}}\\p{{N}}]')
        OR (n >= 5 AND NOT regexp_matches(line, '\\p{{Ll}}') AND regexp_matches(line, '\\p{{Lu}}'))
        OR (n < 25 AND (regexp_matches(line, '{ENDS}') OR length(line) - length(regexp_replace(line, '[|»]', '', 'g')) >= 3 OR regexp_matches(lower(line), '{_phrases}'))) AS fails FROM f),
c AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, sum(size) AS chars, coalesce(sum(size) FILTER (NOT fails), 0) AS kept_chars FROM v GROUP BY doc_id),
a AS (SELECT d.doc_id, len(w) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
             length(text) - length(regexp_replace(text, '{_symbol_class}', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(chars, 0) AS chars, coalesce(kept_chars, 0) AS kept_chars
      FROM d LEFT JOIN r USING (doc_id) LEFT JOIN c USING (doc_id)),
j AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM a)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND 100 * kept_chars >= {MIN_KEPT_PERCENT} * word_chars AS kept
FROM j
"""

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
t AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
g AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY array_to_string(w[i : i + 12], ' ')) AS first FROM t),
p AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM g WHERE first < doc_id),
x AS (SELECT doc_id, list(p) AS gone FROM p GROUP BY doc_id),
k AS (SELECT d.doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d WHERE len(w) > 0),
s AS (SELECT k.doc_id, string_agg(word, ' ' ORDER BY k.p) AS kept FROM k LEFT JOIN p ON k.doc_id = p.doc_id AND k.p = p.p WHERE p.p IS NULL GROUP BY k.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN x USING (doc_id) LEFT JOIN s USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {
    "op2_exact_topk_search": TOP_K,
    "op3_line_dedup": LINES,
    "op4_license_scan": LICENSES,
    "op9_substring_dedup": SUBSTRINGS,
    "op10_quality_rules": RULES,
}
