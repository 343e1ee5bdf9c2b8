"""op12: all conversations replayed, with faults, retries and releases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..oracle_parts import crc32_sql
from ..release import Schedule, replay

NUMBER, NAME = 12, "op12_release"
SCHEDULE = Schedule(every=7, retry=20, attempts=6)

_h = lambda k: crc32_sql(f"('{k}:' || CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR))")
_O = SCHEDULE.offsets
# A row for each depth of the forests, and of each turn the first attempt that delivers.
SQL = f"""
WITH RECURSIVE hashed AS (
  SELECT conv_id, turn, {crc32_sql("coalesce(text, '')")} AS w, {", ".join(f"{_h(k)} AS h{k}" for k in range(3 + SCHEDULE.attempts))} FROM conversations
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, w) - 1 AS p FROM hashed WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), items AS (
  SELECT conv_id, turn, w, p, CASE WHEN h0 % 5 > 0 AND h0 % 5 <= p THEN p - h0 % 5 END AS parent, {SCHEDULE.every} * p AS arrival,
    CASE WHEN h1 % 101 < 50 THEN {SCHEDULE.every} * p + h2 % 101 END AS repaired, {", ".join(f"h{a + 3} % 3 > 0 AS ok{a}" for a in range(SCHEDULE.attempts))} FROM placed
), walk AS (
  SELECT i.conv_id, i.p, false AS blocked, i.arrival AS s,
    CASE WHEN repaired IS NULL THEN 1 {" ".join(f"WHEN ok{a} AND arrival + {o} >= repaired THEN {a + 1}" for a, o in enumerate(_O))} END AS a FROM items i WHERE parent IS NULL
  UNION ALL
  SELECT c.conv_id, c.p, u.a IS NULL AS blocked, CASE WHEN u.a IS NOT NULL THEN greatest(c.arrival, u.s + ({list(_O)})[u.a]) END AS s,
    CASE WHEN u.a IS NULL THEN NULL WHEN repaired IS NULL THEN 1 {" ".join(f"WHEN ok{a} AND greatest(c.arrival, u.s + ({list(_O)})[u.a]) + {o} >= repaired THEN {a + 1}" for a, o in enumerate(_O))} END AS a
  FROM walk u JOIN items c ON c.conv_id = u.conv_id AND c.parent = u.p
), judged AS (
  SELECT conv_id, p, turn, w, CASE WHEN blocked THEN 'blocked' WHEN a IS NULL THEN 'dead' ELSE 'delivered' END AS status, CASE WHEN blocked THEN 0 ELSE coalesce(a, {len(_O)}) END AS attempts,
    s AS first_at, s + ({list(_O)})[coalesce(a, {len(_O)})] AS last_at FROM walk JOIN items USING (conv_id, p)
), ranked AS (
  SELECT conv_id, p, row_number() OVER by_release AS release_no, w FROM judged WHERE status = 'delivered' WINDOW by_release AS (PARTITION BY conv_id ORDER BY last_at, turn, p)
), released AS (SELECT conv_id, p, release_no, sum(release_no * w) OVER (PARTITION BY conv_id ORDER BY release_no) AS state FROM ranked
)
SELECT conv_id, turn, status, CAST(attempts AS INTEGER) AS attempts, first_at, last_at, release_no, CAST(state AS BIGINT) AS state FROM judged LEFT JOIN released USING (conv_id, p)
UNION ALL SELECT conv_id, turn, NULL, NULL, NULL, NULL, NULL, NULL FROM hashed WHERE conv_id IS NULL OR turn IS NULL
"""


def turns(conversations: DataFrame) -> DataFrame:
    """Each turn's parent, fault and chances, drawn by hashes of its name."""
    name = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))

    def h(k: int) -> Column:
        return F.crc32(F.concat(F.lit(f"{k}:"), name).cast("binary"))

    passes = reduce(lambda a, b: a + b, [F.when(h(a + 3) % 3 > 0, F.lit(1 << a)).otherwise(F.lit(0)) for a in range(SCHEDULE.attempts)])
    weight = F.crc32(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    return conversations.select("conv_id", "turn", weight.alias("weight"), (h(0) % 5).alias("back"), F.when(h(1) % 101 < 50, h(2) % 101).alias("wait"), passes.alias("passes"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay(turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")), SCHEDULE)
