"""op11: secrets in all documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..secrets import BASE, RULES, secret_scan, shown

NUMBER, NAME = 11, "op11_secrets"


def _of_rule(number: int, rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""SELECT doc_id, n, {number} AS kind, '{rule.kind}' AS name, unnest(regexp_extract_all(t, '{pattern}')) AS m, unnest(regexp_extract_all(t, '{pattern}', {rule.group})) AS v,
      unnest(string_split_regex(t, '{pattern}')[:-2]) AS gap, generate_subscripts(regexp_extract_all(t, '{pattern}'), 1) AS i FROM base WHERE regexp_matches(t, '{pattern}')"""


_LEAST = " ".join(f"WHEN {k} THEN {r.least}" for k, r in enumerate(RULES))
SQL = f"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS n FROM documents
), found AS ({" UNION ALL ".join(_of_rule(k, r) for k, r in enumerate(RULES))}
), placed AS (
  SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY n, kind ORDER BY i) AS e FROM found
), spans AS (
  SELECT n, kind, name, e - length(m) AS s, name || ':' || CAST(e - length(m) AS BIGINT) || ':' || CAST(e AS BIGINT) AS shown FROM placed WHERE length(v) >= CASE kind {_LEAST} END
), per_row AS (
  SELECT n, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(shown, ',' ORDER BY s, kind) FILTER (kind < {len(BASE)}) AS base, string_agg(shown, ',' ORDER BY s, kind) AS spans
  FROM spans GROUP BY n
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM base LEFT JOIN per_row USING (n)
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("found", lambda s: s["kind"] < len(BASE))

    def count(number: int) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == number)).cast("long")

    counts = [count(k).alias(f"n_{rule.kind}") for k, rule in enumerate(BASE)]
    return scanned.select("doc_id", *counts, F.sha2(F.encode(shown(base), "UTF-8"), 256).alias("base_sha256"), shown(F.col("found")).alias("spans"))
