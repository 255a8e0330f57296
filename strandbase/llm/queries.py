"""The corpus operators' queries over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from . import htmltext, langid, lexicon, licenses, media, neardup, packing, quality, sharding, tokencount

QUERIES = {
    "op1_language_id": langid.query,
    "op2_license_scan": licenses.query,
    "op3_media_columns": media.query,
    "op4_html_extraction": htmltext.query,
    "op5_token_counts": tokencount.query,
    "op6_sharding": sharding.query,
    "op7_packing": packing.query,
    "op8_ngram_jaccard_join": neardup.query,
    "op9_bpe_lexicon": lexicon.query,
    "op10_quality_rules": quality.query,
}

_SPACE = r"[ \t\n\r\x0b\x0c]"

ORACLE_SQL = {
    "op10_quality_rules": rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce('h' || source, 'null') AS host, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(t, '{_SPACE}+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '{_SPACE}', '', 'g') <> '') AS ls,
         regexp_replace(t, '{_SPACE}', '', 'g') AS bare
  FROM d
), g AS (
  SELECT k, i, ws[i] || chr(1) || ws[i + 1] || chr(1) || ws[i + 2] AS key FROM (SELECT k, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), r AS (
  SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, key) AS n FROM g) WHERE n > 1
), c AS (
  SELECT k, count(DISTINCT i + j) AS n_repeat_words FROM r CROSS JOIN range(3) AS o(j) GROUP BY k
), m AS (
  SELECT w.k, doc_id, host, len(ws) AS n_words, length(bare) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(ls) AS n_lines,
         length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS n_letters
  FROM w LEFT JOIN c USING (k)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
), v AS (
  SELECT *, base_failed OR n_symbols > 0.2::DOUBLE * n_words OR n_dup_lines > 0.5::DOUBLE * n_lines OR n_upper > 0.5::DOUBLE * n_letters
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words AS failed
  FROM f
), h AS (
  SELECT host, count(*)::DOUBLE AS n, sum(failed::INT)::DOUBLE AS b FROM v GROUP BY host
), p AS (
  SELECT sum(b) / sum(n) AS m, var_pop(b / n) AS var, avg(1 / n) AS inv FROM h
), q AS (
  SELECT m, least(greatest(m * (1 - m) / greatest(var - m * (1 - m) * inv, 1e-9::DOUBLE) - 1, 1), 10000) AS s FROM p
), x AS (
  SELECT host, r - 2 * sqrt(r * (1 - r) / (n + s + 1)) > 0.5::DOUBLE AS host_rejected FROM (SELECT *, (b + m * s) / (n + s) AS r FROM h, q)
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT failed AND NOT host_rejected AS kept, failed, host_rejected
FROM v JOIN x USING (host)
""",
}
