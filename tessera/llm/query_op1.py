"""op1: quality rules over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .quality_rules import RULES, STOP_WORDS, quality_rules


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the base statistics, base_failed and kept of every document."""
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _bounds() -> str:
    out = []
    for r in RULES:
        out += [f"{r.statistic} >= {r.low}"] if r.low is not None else []
        out += [f"{r.statistic} <= {r.high}"] if r.high is not None else []
    return " AND ".join(out)


_STOPS = ", ".join(f"'{w}'" for w in dict.fromkeys([*STOP_WORDS, *map(str.capitalize, STOP_WORDS)]))

QUERY = ("op1_quality_rules", run)
ORACLE_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), g AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), p AS (
  SELECT r, count(DISTINCT j) AS n FROM (
    SELECT r, unnest([i, i + 1, i + 2]) AS j FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1
  ) GROUP BY r
), s AS (
  SELECT doc_id, len(w) AS n_words, coalesce(length(list_reduce(list_prepend('', w), lambda a, b: a || b)), 0) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
    len(list_filter(w, lambda x: x IN ({_STOPS}))) AS n_stop_words,
    length(t) - length(regexp_replace(t, '[A-Z]+', '', 'g')) AS n_upper,
    len(list_filter(l, lambda x: regexp_matches(x, '^ *[-*•]'))) AS n_bullet_lines,
    len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)$'))) AS n_ellipsis_lines
  FROM d LEFT JOIN p USING (r)
), q AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0.0 END AS mean_word_chars,
    CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0.0 END AS symbol_ratio,
    CASE WHEN n_words > 0 THEN n_stop_words / n_words ELSE 0.0 END AS stop_ratio,
    CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0.0 END AS dup_line_ratio,
    CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0.0 END AS repeat_ratio,
    CASE WHEN word_chars > 0 THEN n_upper / word_chars ELSE 0.0 END AS upper_ratio,
    CASE WHEN n_lines > 0 THEN n_bullet_lines / n_lines ELSE 0.0 END AS bullet_line_ratio,
    CASE WHEN n_lines > 0 THEN n_ellipsis_lines / n_lines ELSE 0.0 END AS ellipsis_line_ratio
  FROM s
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND {_bounds()} AS kept
FROM q
"""
