"""op1: quality verdicts of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..quality import RULES, STOP_WORDS, quality

NUMBER, NAME = 1, "op1_quality"


def _bound(rule) -> str:
    parts = []
    if rule.least is not None:
        parts.append(f"CAST({rule.numerator} AS DOUBLE) >= CAST({rule.least} AS DOUBLE) * {rule.denominator}")
    if rule.most is not None:
        parts.append(f"CAST({rule.numerator} AS DOUBLE) <= CAST({rule.most} AS DOUBLE) * {rule.denominator}")
    return " AND ".join(parts)


_STOPS = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS.split())))

SQL = rf"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS t FROM documents
), split AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM base
), places AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM split
), windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM places
), covered AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE n > 1
), repeated AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM covered GROUP BY doc_id
), counts AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines,
    len(list_filter(w, lambda x: x IN ({_STOPS}))) AS n_stop_words
  FROM split LEFT JOIN repeated USING (doc_id)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {", ".join(f"({_bound(r)}) AS rule_{r.name}" for r in RULES)} FROM counts
)
SELECT doc_id, {", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words"))},
  base_failed, {", ".join(f"rule_{r.name}" for r in RULES)}, NOT base_failed AND {" AND ".join(f"rule_{r.name}" for r in RULES)} AS kept
FROM judged
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
