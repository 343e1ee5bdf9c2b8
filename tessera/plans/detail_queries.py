"""Wrappers, passages, names, subsets and runs that are taken up again, over the given tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import evaluation as ev
from ..operators import mvp
from ..operators import selection as se
from ..registry import query
from ..sources import readers, sinks
from .collection_queries import _serve
from .surrogate import BASES, RECORDS, TAGGED, _case, documents, events, table

_START, _END, _RADIUS = 300, 320, 120
_MARKS = ("'. '", "'.' || chr(10)", "chr(10) || chr(10)")
_AFTER = "coalesce(" + ", ".join(f"CASE WHEN instr(reverse(head), reverse({m})) > 0 THEN length(head) - instr(reverse(head), reverse({m})) + 1 END" for m in _MARKS) + ", 0)"
_BEFORE = "coalesce(" + ", ".join(f"nullif(instr(tail, {m}), 0)" for m in _MARKS) + ", length(tail))"


@query(
    "wrapped_passages",
    f"""WITH t AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE text IS NOT NULL), s AS (SELECT *, least(n, {_START}) AS a, least(n, {_END}) AS b FROM t),
    w AS (SELECT *, greatest(0, a - {_RADIUS}) AS l, least(n, b + {_RADIUS}) AS r FROM s), p AS (SELECT *, substr(text, l + 1, a - l) AS head, substr(text, b + 1, r - b) AS tail FROM w),
    c AS (SELECT *, CASE WHEN l > 0 THEN {_AFTER} ELSE 0 END AS skip, CASE WHEN r < n THEN {_BEFORE} ELSE length(tail) END AS keep FROM p)
    SELECT doc_id, n, regexp_replace(substr(text, CAST(l + skip + 1 AS BIGINT), CAST((b - l) - skip + keep AS BIGINT)), '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g') AS passage FROM c WHERE text <> ''""",
)
def wrapped_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in a filing's wrapper, taken out again, and a span's surroundings cut at sentence ends."""
    d = table(spark, sf_dir, "documents").where("text is not null and text <> ''")
    raw = F.concat(F.lit("<SEC-HEADER>x</SEC-HEADER>\n<DOCUMENT>\n<TYPE>8-K\n<TEXT>"), "text", F.lit("</TEXT>\n</DOCUMENT><DOCUMENT><TEXT>other</TEXT>"))
    inner = d.select("doc_id", tx.strip_wrapper(raw).alias("text"))
    n = F.length("text")
    return inner.select("doc_id", n.cast("long").alias("n"), tx.expand_passage(F.col("text"), F.least(n, F.lit(_START)), F.least(n, F.lit(_END)), _RADIUS).alias("passage"))


@query("tender_files", f"WITH {RECORDS} SELECT hit_id, accession || '__' || filename || '.txt' AS name FROM docs WHERE starts_with(form, 'SC TO-') OR starts_with(form, 'SC 14D9')")
def tender_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tender subset that is written in step with the documents, with the names of its text files."""
    root = sinks.work_folder(spark, "subset")
    se.write_with_subset(documents(spark, sf_dir), f"{root}/all", f"{root}/tender")
    held = spark.read.parquet(f"{root}/tender")
    return held.select("hit_id", tx.safe_name(F.col("accession"), F.concat(F.lit("folder/"), "filename"), ".txt").alias("name"))


@query("tagged_catalog", f"WITH {TAGGED} SELECT event_id, event_type, in_core, in_preferred, in_stretch, amendment_band FROM tagged")
def tagged_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that were written without tags, loaded with them."""
    path = sinks.work_folder(spark, "catalog")
    events(spark, sf_dir).write.parquet(path)
    return mvp.load_tagged(spark, path).select("event_id", "event_type", "in_core", "in_preferred", "in_stretch", "amendment_band")


@query("resumed_run", "SELECT o_orderkey AS accession, o_totalprice AS score FROM orders WHERE o_orderkey <= (SELECT max(o_orderkey) // 3 FROM orders)")
def resumed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of a run's first third, accepted since they are those of the same input and model."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("accession"), F.col("o_orderkey").alias("pos"), F.col("o_totalprice").alias("score"), F.lit("m1").alias("model"))
    path, last = sinks.work_folder(spark, "run"), o.agg(F.max("pos")).first()[0]
    o.where(F.col("pos") <= last // 3).write.parquet(path)
    done = ev.require_columns(spark.read.parquet(path), ["accession", "pos", "model", "score"])
    return se.refuse_other_run(done, o.select("accession", "pos"), "m1").select("accession", "score")


@query(
    "paged_hits",
    f"""WITH o AS (SELECT *, {_case(BASES, "o_orderpriority", "NULL")} AS form FROM orders)
    SELECT form, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, min(lpad(CAST(o_orderkey AS VARCHAR), 10, '0')) AS first FROM o WHERE form IS NOT NULL GROUP BY ALL""",
)
def paged_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as hits, read through the paged search in windows of months."""
    root = sinks.work_folder(spark, "pages")
    _serve(spark, sf_dir, root)
    ends = table(spark, sf_dir, "orders").agg(F.date_format(F.min("o_orderdate"), "yyyy-MM-dd"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd")).first()
    spark.dataSource.register(readers.SearchSource)
    hits = spark.read.format("paged_search").options(start=ends[0], end=ends[1], forms=",".join(BASES.values()), page_size="50", fetcher="tessera.plans.collection_queries:page", fetcher_args=json.dumps({"root": root})).load()
    return hits.groupBy("form", F.substring("window_start", 1, 7).alias("month")).agg(F.count(F.lit(1)).alias("n"), F.min(F.get_json_object("hit", "$._source.adsh")).alias("first"))
