"""The filing corpus that the queries run on, made from the star-schema tables.

A line item is a document, its order a filing, the customer the issuer; forms,
amendments, exhibits, file names and names follow from their columns. The same
tables exist as SQL for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import FORM_FAMILIES, FORMATS
from ..operators.corpus import document_table, event_table, is_exhibit, is_primary, lookup

BASES = {"1-URGENT": "SC TO-T", "2-HIGH": "SC TO-I", "3-MEDIUM": "SC 14D9", "4-NOT SPECIFIED": "S-4", "5-LOW": "8-K"}
ENDINGS = (".htm", ".HTML", ".txt", ".pdf", ".xml", ".jpg", "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record a line item.

    Customers meet their orders before these meet the lines, so that only parts and
    orders move the lines. The lines meet their order last, by accession and without
    a broadcast: what groups by filing then finds the rows of a filing together, and
    needs no shuffle of its own.
    """
    l, o, c, p = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "part"))
    filings = o.join(c, o.o_custkey == c.c_custkey).withColumn("filing", F.col("o_orderkey").cast("string")).withColumn("base", lookup(BASES, F.col("o_orderpriority")))
    lines = l.join(p, l.l_partkey == p.p_partkey).withColumn("accession", F.col("l_orderkey").cast("string"))
    j = lines.join(filings.hint("merge"), F.col("accession") == F.col("filing"))
    line, supplier = F.col("l_linenumber"), F.col("l_suppkey")
    base = F.col("base")
    amended = (F.col("l_returnflag") == "R") & (line == 1) & (base != "8-K")
    form = F.when(amended, F.concat(base, F.lit("/A"))).otherwise(base)
    kind = F.when(line == 1, form).when(line == 2, "EX-99.(A)(1)(A)").when(line == 3, "EX-99.(A)(1)(B)").when(F.col("l_linestatus") == "F", "EX-99").otherwise("GRAPHIC")
    about = F.when((line == 2) & (supplier % 2 == 0), "Offer to Purchase").when(line == 3, "Letter of Transmittal").otherwise(F.col("p_name"))
    endings = F.array(*[F.lit(e) for e in ENDINGS])
    cik = F.lpad(F.col("c_custkey").cast("string"), 10, "0")
    out = j.select(
        F.concat_ws(":", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("hit_id"),
        "accession",
        F.concat(F.lit("d"), F.col("l_partkey").cast("string"), F.get(endings, (supplier % 7).cast("int"))).alias("filename"),
        form.alias("form"),
        lookup(FORM_FAMILIES, form, "other").alias("form_family"),
        kind.alias("file_type"),
        about.alias("file_description"),
        F.when(line != 7, F.col("o_orderdate").cast("date")).alias("file_date"),
        line.alias("sequence"),
        F.array(cik).alias("ciks"),
        cik.alias("primary_cik"),
        F.when(line == 5, F.lit(None)).when(supplier % 11 == 0, F.upper("c_name")).otherwise(F.col("c_name")).alias("entity_name"),
        F.when(F.col("l_discount") == 0, F.array().cast("array<string>")).otherwise(F.split("p_name", " ")).alias("tickers"),
        F.when(base != "8-K", F.concat(F.lit("005-"), F.lpad(F.col("o_custkey").cast("string"), 5, "0"))).alias("primary_file_num"),
        amended.alias("is_amendment"),
    )
    exhibit = is_exhibit(F.col("file_type"), F.col("file_description"))
    return out.withColumn("is_exhibit", exhibit).withColumn("is_primary_form_doc", is_primary(F.col("form"), F.col("file_type"), exhibit))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_table(records(spark, sf_dir))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_table(documents(spark, sf_dir))


def _case(table: dict[str, str], key: str, default: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {default} END"


RECORDS = f"""
base AS (
  SELECT *, {_case(BASES, "o_orderpriority", "NULL")} AS b
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey
), shaped AS (
  SELECT *, l_returnflag = 'R' AND l_linenumber = 1 AND b <> '8-K' AS is_amendment,
    CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 AND b <> '8-K' THEN b || '/A' ELSE b END AS form FROM base
), records AS (
  SELECT concat_ws(':', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS hit_id, CAST(l_orderkey AS VARCHAR) AS accession,
    'd' || l_partkey || [{", ".join(f"'{e}'" for e in ENDINGS)}][l_suppkey % 7 + 1] AS filename, form, {_case(FORM_FAMILIES, "form", "'other'")} AS form_family,
    CASE WHEN l_linenumber = 1 THEN form WHEN l_linenumber = 2 THEN 'EX-99.(A)(1)(A)' WHEN l_linenumber = 3 THEN 'EX-99.(A)(1)(B)' WHEN l_linestatus = 'F' THEN 'EX-99' ELSE 'GRAPHIC' END AS file_type,
    CASE WHEN l_linenumber = 2 AND l_suppkey % 2 = 0 THEN 'Offer to Purchase' WHEN l_linenumber = 3 THEN 'Letter of Transmittal' ELSE p_name END AS file_description,
    CASE WHEN l_linenumber <> 7 THEN CAST(o_orderdate AS DATE) END AS file_date, l_linenumber AS sequence, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS primary_cik,
    CASE WHEN l_linenumber = 5 THEN NULL WHEN l_suppkey % 11 = 0 THEN upper(c_name) ELSE c_name END AS entity_name,
    CASE WHEN l_discount = 0 THEN [] ELSE string_split(p_name, ' ') END AS tickers,
    CASE WHEN b <> '8-K' THEN '005-' || lpad(CAST(o_custkey AS VARCHAR), 5, '0') END AS primary_file_num, is_amendment,
    l_linenumber > 1 AND (l_linenumber <= 3 OR l_linestatus = 'F') AS is_exhibit, l_linenumber = 1 AS is_primary_form_doc
  FROM shaped
), docs AS (
  SELECT *, coalesce(primary_file_num, 'NO_FILE_NUM:' || accession) AS event_id, nullif(regexp_extract(lower(filename), '(\\.[a-z0-9]+)$', 1), '') AS doc_ext,
    {_case(FORMATS, "nullif(regexp_extract(lower(filename), '(\\.[a-z0-9]+)$', 1), '')", "'other'")} AS format_guess
  FROM records
)"""

EVENTS = (
    RECORDS
    + """, evs AS (
  SELECT event_id, count(*) AS n_documents, count(DISTINCT accession) AS n_filings, count(DISTINCT accession) FILTER (is_amendment) AS n_amendment_filings,
    count(DISTINCT accession) FILTER (NOT is_amendment) AS n_initial_filings, list_sort(list(DISTINCT form)) AS forms, list_sort(list(DISTINCT form_family)) AS form_families,
    list_sort(list(DISTINCT entity_name) FILTER (entity_name IS NOT NULL)) AS entity_names,
    arg_min(entity_name, (file_date IS NULL, coalesce(file_date, DATE '1900-01-01'), accession, sequence, hit_id)) FILTER (entity_name IS NOT NULL) AS primary_entity,
    list_sort(list(DISTINCT primary_cik)) AS ciks, min(primary_cik) AS primary_cik, list_sort(list_distinct(flatten(list(tickers)))) AS tickers,
    min(file_date) AS first_file_date, max(file_date) AS last_file_date, count(*) FILTER (is_exhibit) AS n_exhibits, count(*) FILTER (is_primary_form_doc) AS n_primary_docs,
    count(DISTINCT accession) FILTER (is_amendment) > 0 AS has_amendment, CAST(date_diff('day', min(file_date), max(file_date)) AS BIGINT) AS event_span_days,
    CASE WHEN count(DISTINCT form_family) = 1 THEN min(form_family) WHEN count(DISTINCT form_family) > 1 THEN 'mixed' END AS primary_form_family
  FROM docs GROUP BY event_id
)"""
)

TAGGED = (
    EVENTS
    + """, flags AS (
  SELECT *, len(list_filter(forms, lambda f: starts_with(f, 'SC TO-T'))) > 0 AS has_to_t, len(list_filter(forms, lambda f: starts_with(f, 'SC TO-I'))) > 0 AS has_to_i,
    len(list_filter(forms, lambda f: starts_with(f, 'SC 14D9'))) > 0 AS has_14d9, NOT starts_with(event_id, 'NO_FILE_NUM:') AS has_file_num FROM evs
), tagged AS (
  SELECT *, CASE WHEN has_to_t OR has_to_i THEN 'tender_offer' ELSE 'unknown' END AS event_type, has_to_t AND has_file_num AS in_core,
    has_to_t AND has_file_num AND has_14d9 AS in_preferred, has_to_i AND NOT has_to_t AND has_file_num AS in_stretch,
    CASE WHEN NOT (has_to_t AND has_file_num AND has_amendment) THEN 'out_of_core' WHEN n_amendment_filings BETWEEN 1 AND 5 AND n_documents <= 60 THEN 'simple'
      WHEN n_amendment_filings >= 6 OR n_documents > 60 THEN 'complex' ELSE 'other_core' END AS amendment_band FROM flags
)"""
)

VERSIONS = """, filings AS (
  SELECT event_id, accession, min(form) AS form, min(file_date) AS file_date, bool_or(is_amendment) AS is_amendment FROM docs GROUP BY ALL
), versions AS (
  SELECT event_id, CAST(row_number() OVER (PARTITION BY event_id ORDER BY file_date NULLS LAST, accession) AS BIGINT) AS version_no, accession, form, file_date, is_amendment,
    CASE WHEN is_amendment THEN 'amended' ELSE 'initial' END AS version_status FROM filings
)"""
