"""op10: quality rules over every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .quality_rules import RULES, STOP_WORDS, quality_rules

NAME = "op10_quality_rules"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, base verdict and the verdict of the threshold table for every document."""
    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_METRIC_SQL = {
    "mean_word_chars": "CASE WHEN n_words > 0 THEN word_chars::DOUBLE / n_words ELSE 0 END",
    "symbols_per_word": "CASE WHEN n_words > 0 THEN n_symbols::DOUBLE / n_words ELSE 0 END",
    "stop_word_ratio": "CASE WHEN n_words > 0 THEN n_stop::DOUBLE / n_words ELSE 0 END",
    "dup_line_ratio": "CASE WHEN n_lines > 0 THEN n_dup_lines::DOUBLE / n_lines ELSE 0 END",
}
_STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)
_RULE_SQL = " AND ".join(f"({_METRIC_SQL[m]}) {op} {v}" for m, op, v in RULES)

SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM d
), g AS (
  SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3
), k AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS c FROM g
), p AS (
  SELECT DISTINCT r, i + s.o AS j FROM k, (SELECT unnest([0, 1, 2]) AS o) s WHERE c > 1
), n AS (
  SELECT r, count(*) AS c FROM p GROUP BY r
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(n.c, 0)::BIGINT AS n_repeat_words,
         len(list_filter(w, lambda x: lower(x) IN ({_STOP_SQL})))::BIGINT AS n_stop
  FROM w LEFT JOIN n USING (r)
), f AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND {_RULE_SQL}) AS kept
FROM f
"""
