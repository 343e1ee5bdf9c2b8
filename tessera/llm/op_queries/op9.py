"""op9: WARC archives of all pages, written and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..warc import page_of, round_trip

NUMBER, NAME = 9, "op9_warc"
_BIT = " + ".join(f"{16 >> b} * CAST(substr(bits, 5 * k + {b + 1}, 1) AS INT)" for b in range(5))

SQL = f"""
WITH hashed AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(encode(coalesce(html, ''))) AS hex FROM pages
), binary_ AS (SELECT *, array_to_string(list_transform(string_split(hex, ''), lambda c: lpad(bin(CAST('0x' || c AS INT)), 4, '0')), '') AS bits FROM hashed
), named AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {_BIT}, 1)), '') AS payload_digest,
    max(page_id) OVER (PARTITION BY hex) AS response FROM binary_
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> response THEN response END AS refers_to, true AS valid
FROM named
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return records.select(page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of(F.col("refers_to")).alias("refers_to"), "valid")
