"""op13: periodic runs in all documents, a tenth of which is made periodic first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ...functions.arrays import let
from ..oracle_parts import crc32_sql
from ..quality import SPACE
from ..runs import periodic_runs

NUMBER, NAME = 13, "op13_runs"
# Every run holds six consecutive words twice, one period apart: such pairs of places, in stretches of one distance.
SQL = rf"""
WITH split AS (
  SELECT doc_id, row_number() OVER () AS n, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {crc32_sql("CAST(doc_id AS VARCHAR)")} AS h FROM documents
), given AS (
  SELECT *, len(w) AS k, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM split
), texts AS (
  SELECT doc_id, n, k, CASE WHEN a IS NULL THEN w ELSE list_transform(range(k), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (k - a) // (3 + g % 8)) END]) END AS w FROM given
), windows AS (SELECT n, k, w, unnest(range(k - 5)) AS i FROM texts WHERE k >= 12
), keyed AS (SELECT n, k, i, array_to_string(w[i + 1:i + 6], ' ') AS t FROM windows
), pairs AS (SELECT l.n, l.i, r.i - l.i AS q FROM keyed l JOIN keyed r ON l.n = r.n AND l.t = r.t AND r.i > l.i AND 2 * (r.i - l.i) <= l.k
), stretches AS (SELECT n, q, i, i - row_number() OVER (PARTITION BY n, q ORDER BY i) AS stretch FROM pairs
), found AS (
  SELECT n, min(i) AS s, count(*) + 5 + q AS k, q FROM stretches GROUP BY n, q, stretch HAVING count(*) + 5 + q >= greatest(12, 2 * q)
), runs AS (SELECT n, s, k, min(q) AS q FROM found GROUP BY n, s, k
), best AS (
  SELECT n, count(*) AS n_runs, sha256(string_agg(s || ',' || k || ',' || q || chr(10), '' ORDER BY s, q)) AS runs_sha256, min({{'k': -k, 's': s, 'q': q}}) AS b FROM runs GROUP BY n
), gone AS (SELECT DISTINCT n, unnest(range(s + q, s + k)) AS i FROM runs
), words AS (SELECT n, unnest(range(k)) AS i, unnest(w) AS x FROM texts
), collapsed AS (SELECT n, string_agg(x, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (n, i) GROUP BY n
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, CAST(-b.k AS BIGINT) AS length, b.q AS period, CAST(1000 * -b.k // b.q AS BIGINT) AS exponent_milli,
  coalesce(runs_sha256, sha256('')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM texts LEFT JOIN best USING (n) LEFT JOIN collapsed USING (n)
"""


def made_periodic(docs: DataFrame) -> DataFrame:
    """The documents; of those whose id's crc32 is a multiple of 10, the words from a place on repeat with a period that the crc32 gives.

    A null id has no crc32: such texts stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))

    def of(words: Column) -> Column:
        n, g = F.size(words).cast("long"), F.call_function("div", h, F.lit(10))
        a = F.when(n > 0, g % F.greatest(n, F.lit(1)))
        p = F.lit(1) + F.call_function("div", n - a, 3 + g % 8)
        changed = let(F.struct(a.cast("int").alias("a"), p.cast("int").alias("p")), lambda x: F.transform(words, lambda w, i: F.when(i < x["a"], w).otherwise(F.get(words, x["a"] + (i - x["a"]) % x["p"]))))
        return F.array_join(changed, " ")

    text = F.col("text").cast("string")
    words = F.array_remove(F.split(text, SPACE), "")
    return docs.withColumn("text", F.when((h % 10 == 0) & (F.size(words) > 0), let(words, of)).otherwise(text))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(made_periodic(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
