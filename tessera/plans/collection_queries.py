"""The collector, keyed tables and databases, run over the given tables."""

from __future__ import annotations

import bisect
import functools
import json
from pathlib import Path
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..sources import sinks
from ..sources.database import SqliteFile
from ..sources.tables import KeyedTable
from ..streaming import collector as co
from ..streaming import ingest
from .surrogate import BASES, _case, lookup, table

TRACKS = {"tender": (("tender_offer",), ("SC TO-T", "SC TO-I", "SC 14D9")), "merger_exchange": (("merger", "exchange_offer"), ("S-4", "SC TO-I")), "conversion": (("conversion",), ("8-K",))}


@functools.lru_cache(maxsize=1)
def _served(root: str, form: str, month: str) -> list[tuple[str, str, str]]:
    """(day, id, hit as JSON) of a form's month in order of days, held while a task pages through it."""
    from pyarrow import fs

    files, base = fs.FileSystem.from_uri(root)
    folder = fs.FileSelector(f"{base}/form_key={form.replace(' ', '_')}/month={month}", allow_not_found=True)
    hits = []
    for info in files.get_file_info(folder):
        if info.path.endswith(".json"):
            with files.open_input_stream(info.path) as stream:
                for line in stream.read().decode().splitlines():
                    hit = json.loads(line)
                    hits.append((hit["_source"]["file_date"], hit["_id"], line))
    return sorted(hits)


@functools.lru_cache(maxsize=1)
def _within(root: str, form: str, start: str, end: str) -> list[str]:
    """The hits of days of one month in order of ids."""
    hits = _served(root, form, start[:7])
    days = lambda hit: hit[0]
    found = hits[bisect.bisect_left(hits, start, key=days) : bisect.bisect_right(hits, end, key=days)]
    return [line for _, _, line in sorted(found, key=lambda hit: hit[1])]


def page(form: str, start: str, end: str, offset: int, size: int, root: str) -> tuple[int, list[dict]]:
    """A page of the hits that ``_serve`` wrote: (total, hits of the form within the days)."""
    hits = _within(root, form, start, end)
    return len(hits), [json.loads(line) for line in hits[offset : offset + size]]


def _serve(spark: SparkSession, sf_dir: str, root: str) -> None:
    """Orders as search hits, in files by form and month."""
    o = table(spark, sf_dir, "orders")
    form = lookup(BASES, F.col("o_orderpriority"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    number = F.lpad(F.col("o_orderkey").cast("string"), 10, "0")
    source = F.struct(
        number.alias("adsh"), form.alias("form"), F.array(form).alias("root_forms"), form.alias("file_type"), day.alias("file_date"), F.lit("1").alias("sequence"),
        F.array(F.lpad(F.col("o_custkey").cast("string"), 10, "0")).alias("ciks"), F.array(F.concat(F.lit("005-"), F.col("o_custkey").cast("string"))).alias("file_num"),
    )
    hits = o.where(form.isNotNull()).select(F.concat(number, F.lit(":d.htm")).alias("_id"), source.alias("_source"), F.replace(form, F.lit(" "), F.lit("_")).alias("form_key"), F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    hits.repartition("form_key", "month").write.partitionBy("form_key", "month").json(root)


@query(
    "collected_records",
    f"""WITH o AS (SELECT *, {_case(BASES, "o_orderpriority", "NULL")} AS form FROM orders)
    SELECT lpad(CAST(o_orderkey AS VARCHAR), 10, '0') || ':d.htm' AS hit_id, form, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS file_date, lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS primary_cik, '005-' || o_custkey AS primary_file_num,
      CASE form WHEN 'S-4' THEN 'merger_exchange' WHEN '8-K' THEN 'conversion' ELSE 'tender' END AS collection_track,
      CASE form WHEN 'S-4' THEN 'merger|exchange_offer' WHEN '8-K' THEN 'conversion' ELSE 'tender_offer' END AS mvp_event_types FROM o WHERE form IS NOT NULL""",
)
def collected_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as hits of a paged search, collected in two runs; the second takes up where the first one ended."""
    root = sinks.work_folder(spark, "collector")
    _serve(spark, sf_dir, f"{root}/served")
    ends = table(spark, sf_dir, "orders").agg(F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("a"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("b")).first()
    for end in ("1995-06-15", ends["b"]):
        records = co.collect(spark, root, ends["a"], end, "tessera.plans.collection_queries:page", TRACKS, fetcher_args={"root": f"{root}/served"})
    return records.select("hit_id", "form", F.col("file_date").cast("string").alias("file_date"), "primary_cik", "primary_file_num", "collection_track", F.array_join("mvp_event_types", "|").alias("mvp_event_types"))


@query(
    "upsert_parts",
    """SELECT c_custkey, CASE WHEN c_custkey BETWEEN 100 AND 180 THEN upper(c_name) ELSE c_name END AS c_name,
      CASE WHEN c_custkey BETWEEN 100 AND 180 AND c_custkey % 2 = 0 THEN 2 * c_acctbal ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer
    UNION ALL SELECT c_custkey + 10000000, c_name, c_acctbal, c_mktsegment FROM customer WHERE c_custkey < 30""",
)
def upsert_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by ranges of keys; a change of a few neighbours and some new keys reads and replaces their ranges alone."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    held = KeyedTable(spark, sinks.work_folder(spark, "upsert"), ["c_custkey"], part=F.call_function("div", F.col("c_custkey"), F.lit(100)))
    held.write(c)
    changed = c.where("c_custkey between 100 and 180").select("c_custkey", F.upper("c_name").alias("c_name"), F.when(F.col("c_custkey") % 2 == 0, 2 * F.col("c_acctbal")).alias("c_acctbal"), F.lit("none").alias("c_mktsegment"))
    added = c.where("c_custkey < 30").withColumn("c_custkey", F.col("c_custkey") + 10_000_000)
    held.upsert(changed.unionByName(added), keep=["c_mktsegment"], fill=["c_acctbal"])
    return held.read().drop("part")


@query("streamed_by_month", "SELECT strftime(ts, '%Y-%m') AS part, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1")
def streamed_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream into a table by month; a batch looks for known events in its months alone. A second checkpoint brings all of them again."""
    root = sinks.work_folder(spark, "stream")
    source = table(spark, sf_dir, "events")
    source.union(source.where("event_id % 10 = 0")).repartitionByRange(4, "ts").write.parquet(f"{root}/in")
    held = KeyedTable(spark, f"{root}/out", ["event_id"], part=F.date_format("ts", "yyyy-MM"))
    for run in ("a", "b"):
        ingest.run_into(ingest.file_stream(spark, f"{root}/in", source.schema, 2), held, f"{root}/check-{run}")
    return held.read().groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("database_round_trip", "SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS total, min(c_name) AS first FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0 GROUP BY c_nationkey")
def database_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written to a database file that all executors share, and read back in four ranges of their key, with the filter and the columns left to it."""
    folder = urlsplit(sinks.work_folder(spark, "database"))
    if folder.scheme not in ("", "file"):
        raise ValueError("a database file wants a shared folder that is mounted, not " + folder.scheme)
    db = SqliteFile(f"{unquote(folder.path)}.sqlite")
    Path(db.path).parent.mkdir(parents=True, exist_ok=True)
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", F.col("c_nationkey").cast("long").alias("c_nationkey"), "c_mktsegment", F.col("c_acctbal").cast("double").alias("c_acctbal"))
    db.write(c, "customer", "overwrite", parts=4)
    db.index("customer", "c_custkey")
    read = db.read(spark, "customer", "c_name string, c_nationkey long, c_acctbal double", "c_custkey", parts=4, where="c_mktsegment = 'BUILDING' and c_acctbal > 0")
    return read.groupBy(F.col("c_nationkey").cast("long").alias("c_nationkey")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"), F.min("c_name").alias("first"))
