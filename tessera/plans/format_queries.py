"""Archives by member and manifests of differing shapes, over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import stages as st
from ..registry import query
from ..sources import archives, sinks
from .surrogate import table


@query("archive_members", "SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 'empty text' END AS error, length(text) AS n_chars, md5(text) AS digest FROM documents")
def archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as JSON members of archives, as many as their size asks for, read back in parts of a megabyte."""
    path = sinks.work_folder(spark, "archives")
    d = table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".json")).alias("member"), F.to_json(F.struct("doc_id", "text")).alias("content"))
    archives.write_archives(d.hint("rebalance", "member"), path, "member", "content").count()
    read = archives.read_json_members(spark, path, "doc_id long, text string", megabytes=1)
    text = F.col("document.text")
    return read.select(F.col("document.doc_id").alias("doc_id"), "error", F.length(text).cast("long").alias("n_chars"), F.md5(F.encode(text, "UTF-8")).alias("digest"))


# A variant has its keys in order of name.
_MANIFEST = """'{"stage":"' || event_type || '","status":"ok","ended":"2024-01-02T03:04:05"' ||
  CASE event_type WHEN 'click' THEN ',"n":' || event_id WHEN 'view' THEN ',"files":{"bad":[' || user_id || ',1],"ok":' || event_id || '}' WHEN 'purchase' THEN ',"rate":null,"name":"a\\"b"' ELSE '' END || '}'"""


def _manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind, n = F.col("event_type"), F.col("event_id").cast("string")
    more = (
        F.when(kind == "click", F.concat(F.lit(',"n":'), n))
        .when(kind == "view", F.concat(F.lit(',"files":{"ok":'), n, F.lit(',"bad":['), F.col("user_id").cast("string"), F.lit(",1]}")))
        .when(kind == "purchase", F.lit(',"rate":null,"name":"a\\"b"')).otherwise("")
    )
    text = F.concat(F.lit('{"stage":"'), kind, F.lit('","status":"ok","ended":"2024-01-02T03:04:05"'), more, F.lit("}"))
    path = sinks.work_folder(spark, "manifests")
    st.manifests(e.select(text.alias("value"))).write.parquet(path)
    return spark.read.parquet(path)


@query(
    "manifest_metrics",
    f"""WITH m AS (SELECT event_type AS stage, CAST({_MANIFEST} AS JSON) AS j FROM events), k AS (SELECT stage, j, unnest(json_keys(j)) AS metric FROM m)
    SELECT stage, CAST('2024-01-02 03:04:05' AS VARCHAR) AS ended, metric, CAST(json_extract(j, '$.' || metric) AS VARCHAR) AS value, count(*) AS n FROM k WHERE metric NOT IN ('stage', 'status', 'ended') GROUP BY ALL""",
)
def manifest_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests whose metrics differ from stage to stage, in one table, as flat rows."""
    rows = st.metric_rows(_manifests(spark, sf_dir)).withColumn("ended", F.date_format("ended", "yyyy-MM-dd HH:mm:ss"))
    return rows.groupBy("stage", "ended", "metric", "value").agg(F.count(F.lit(1)).alias("n"))


@query(
    "manifest_shapes",
    """SELECT event_type AS stage, CASE event_type WHEN 'click' THEN 'OBJECT<ended: STRING, n: BIGINT, stage: STRING, status: STRING>' WHEN 'view' THEN 'OBJECT<ended: STRING, files: OBJECT<bad: ARRAY<BIGINT>, ok: BIGINT>, stage: STRING, status: STRING>'
      WHEN 'purchase' THEN 'OBJECT<ended: STRING, name: STRING, rate: VOID, stage: STRING, status: STRING>' ELSE 'OBJECT<ended: STRING, stage: STRING, status: STRING>' END AS shape, count(*) AS n FROM events GROUP BY event_type""",
)
def manifest_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.metric_shapes(_manifests(spark, sf_dir), "stage")
