"""op3: repeated 35-word passages of all documents, removed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..substrings import substring_dedup

NUMBER, NAME = 3, "op3_substring_dedup"
SQL = r"""
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), places AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM split
), windows AS (SELECT doc_id, i, array_to_string(w[i:i+34], ' ') AS t FROM places
), again AS (SELECT doc_id, i FROM windows WHERE t IN (SELECT t FROM windows GROUP BY t HAVING count(*) > 1)
), covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM again
), gone AS (SELECT doc_id, list(p) AS gone FROM covered GROUP BY doc_id
), words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM split
), left_over AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM words ANTI JOIN covered USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM split LEFT JOIN gone USING (doc_id) LEFT JOIN left_over USING (doc_id)
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
