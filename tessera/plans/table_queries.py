"""Queries over readers, writers, stages and small selections; those that write read their own tables back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import FORM_FAMILIES, TRACKS
from ..functions import text as tx
from ..functions.quantiles import described
from ..operators import corpus as co
from ..operators import datastore as ds
from ..operators import evaluation as ev
from ..operators import reports as rp
from ..operators import sampling as sa
from ..operators import selection as se
from ..operators import spans as sp
from ..operators import stages as st
from ..registry import query
from ..sources import readers, sinks, whole_files
from ..streaming import ingest
from .corpus_queries import longs
from .surrogate import EVENTS, RECORDS, documents, events, table
from .text_queries import _EVIDENCE, _MENTIONS, _PAIRS, _QUEUE, _pairs, _screened, mentions

_BASE = "https://example.org/data"


@query("document_urls", f"WITH {RECORDS} SELECT hit_id, '{_BASE}/' || CAST(primary_cik AS BIGINT) || '/' || replace(accession, '-', '') || '/' || filename AS url, '{_BASE}/' || CAST(primary_cik AS BIGINT) || '/' || replace(accession, '-', '') || '/index.json' AS index_url FROM docs")
def document_urls(spark, sf_dir):
    c = F.col
    return documents(spark, sf_dir).select("hit_id", tx.document_url(_BASE, c("primary_cik"), c("accession"), c("filename")).alias("url"), tx.filing_index_url(_BASE, c("primary_cik"), c("accession")).alias("index_url"))


@query("first_existing", "SELECT n_name, n_regionkey FROM nation")
def first_existing(spark, sf_dir):
    return readers.first_that_exists(spark, (f"{sf_dir}/nations.csv", lambda p: readers.read_csv(spark, p)), (f"{sf_dir}/nation.parquet", spark.read.parquet)).select("n_name", "n_regionkey")


@query("csv_round_trip", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment, '[\"' || c_mktsegment || '\",\"x\"]' AS tags FROM customer")
def csv_round_trip(spark, sf_dir):
    path = sinks.work_folder(spark, "csv")
    sinks.write_report(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", F.array("c_mktsegment", F.lit("x")).alias("tags")), path)
    return readers.read_csv(spark, path)


@query("json_lines_round_trip", "SELECT s_suppkey AS k, s_name AS name, [s_name, upper(s_name)][2] AS second FROM supplier")
def json_lines_round_trip(spark, sf_dir):
    path = sinks.work_folder(spark, "json")
    table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.array("s_name", F.upper("s_name")).alias("both")).write.json(path)
    rows = readers.read_json_lines(spark, path, "k long, name string, both array<string>")
    return se.refuse_duplicates(rows, ["k"]).select("k", "name", F.get("both", F.lit(1)).alias("second"))


@query("whole_texts", "SELECT page_id, contains(lower(substr(html, 1, 1200)), '<html') OR starts_with(ltrim(lower(substr(html, 1, 1200))), '<!doctype') AS is_html, length(html) AS n_chars FROM pages")
def whole_texts(spark, sf_dir):
    """Every page written as a file of its own and read whole."""
    path = sinks.work_folder(spark, "texts")
    whole_files.write_files(table(spark, sf_dir, "pages"), f"{path}/files", "page_id", "html").write.parquet(f"{path}/list")
    read = whole_files.read_files(spark.read.parquet(f"{path}/list"), f"{path}/files", "page_id")
    return read.select("page_id", "is_html", F.length("text").cast("long").alias("n_chars"))


@query("stage_metrics", "SELECT event_id, event_type AS stage, '{\"k\":' || CAST(json_extract(props, '$.k') AS BIGINT) || ',\"list\":[' || user_id || ',' || event_id || ']}' AS detail FROM events")
def stage_metrics(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return st.stage_metrics(e.select("event_id", F.col("event_type").alias("stage"), F.struct(F.get_json_object("props", "$.k").cast("long").alias("k"), F.array(F.col("user_id").cast("long"), F.col("event_id")).alias("list")).alias("detail")))


@query("sample_refresh", f"WITH {RECORDS}, s AS (SELECT hit_id, form, accession FROM docs WHERE sequence = 7) SELECT 'all' AS sample, count(DISTINCT form) < 4 OR count(*) < 20 AS needs_refresh FROM s UNION ALL SELECT 'one_form', count(DISTINCT form) < 4 OR count(*) < 20 FROM s WHERE form = '8-K'")
def sample_refresh(spark, sf_dir):
    s = documents(spark, sf_dir).where("sequence = 7")
    one = lambda name, df: sa.needs_refresh(df).select(F.lit(name).alias("sample"), "needs_refresh")
    return one("all", s).unionByName(one("one_form", s.where("form = '8-K'")))


@query("partition_overwrite", "SELECT o_orderstatus, count(*) AS n, round(sum(CASE WHEN o_orderstatus = 'F' THEN 2 * o_totalprice ELSE o_totalprice END), 2) AS total FROM orders WHERE o_orderstatus <> 'F' OR o_orderkey % 2 = 0 GROUP BY o_orderstatus")
def partition_overwrite(spark, sf_dir):
    """A table by status, of which one partition is replaced; the others stay."""
    path, o = sinks.work_folder(spark, "partitions"), table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    sinks.write_table(o, path, "o_orderstatus")
    sinks.write_partitions(o.where("o_orderstatus = 'F' and o_orderkey % 2 = 0").withColumn("o_totalprice", 2 * F.col("o_totalprice")), path, "o_orderstatus")
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("truncated", "SELECT CAST(c_custkey AS BIGINT) AS k, c_name AS v FROM customer WHERE c_acctbal < 0")
def truncated(spark, sf_dir):
    path = sinks.work_folder(spark, "truncated")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"), "c_acctbal")
    c.drop("c_acctbal").write.parquet(path)
    sinks.truncate(spark, path, "k long, v string")
    c.where("c_acctbal < 0").drop("c_acctbal").write.mode("append").parquet(path)  # what is loaded next is all there is
    return spark.read.parquet(path)


_FACTS = f"""{_MENTIONS}, r AS (SELECT *, score + CASE WHEN regexp_matches(value, '(?i)\\$\\s*[\\d,]+(?:\\.\\d+)?') THEN 0.45 ELSE 0 END AS rank_score FROM mentions),
one AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY accession, lower(value) ORDER BY rank_score DESC, pos) = 1),
facts AS (SELECT accession AS event_id, row_number() OVER (PARTITION BY accession ORDER BY rank_score DESC, pos) - 1 AS fact_no, value AS raw, round(rank_score, 6) AS rank_score FROM one)"""


def _reps(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mentions(spark, sf_dir)
    spans = m.select(F.col("accession").alias("event_id"), F.col("pos").alias("span_id"), F.lit("cash_amount").alias("label"), F.col("value").alias("text"), "score", F.lit("").alias("doc_role"), F.lit("").alias("segment_kind"), F.lit(False).alias("priority"), F.lit("").alias("passage"), F.lit("rule").alias("method"))
    o = table(spark, sf_dir, "orders")
    inventory = o.select(F.col("o_custkey").cast("string").alias("event_id"), F.when(F.col("o_orderkey") % 3 == 0, "sc_14d9").otherwise("otp").alias("role"), F.col("o_orderkey").cast("string").alias("accession"), F.lit("a.htm").alias("filename"))
    downloads = o.where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").cast("string").alias("accession"), F.lit("a.htm").alias("filename"), F.when(F.col("o_orderkey") % 5 == 0, "failed").when(F.col("o_orderkey") % 5 == 1, "skipped").otherwise("ok").alias("status"))
    return st.assemble(inventory, spans, downloads, "rules")


@query("rep_facts", f"WITH {_FACTS} SELECT * FROM facts WHERE fact_no < 12 AND event_id IN (SELECT CAST(o_custkey AS VARCHAR) FROM orders)")
def rep_facts(spark, sf_dir):
    return longs(st.rep_tables(_reps(spark, sf_dir), "tender")["facts"].select("event_id", "fact_no", "raw", F.round("rank_score", 6).alias("rank_score")))


_DOWNLOADED = "CASE WHEN o_orderkey % 4 = 0 THEN 'unknown' WHEN o_orderkey % 5 = 0 THEN 'failed' WHEN o_orderkey % 5 = 1 THEN 'skipped' ELSE 'ok' END"


@query("rep_documents", f"SELECT CAST(o_custkey AS VARCHAR) AS event_id, CAST(o_orderkey AS VARCHAR) AS accession, CASE WHEN o_orderkey % 3 = 0 THEN 'sc_14d9' ELSE 'otp' END AS role, {_DOWNLOADED} AS download_status FROM orders")
def rep_documents(spark, sf_dir):
    return st.rep_tables(_reps(spark, sf_dir), "tender")["documents"].select("event_id", "accession", "role", "download_status")


@query(
    "rep_exceptions",
    f"WITH {_FACTS}, o AS (SELECT CAST(o_custkey AS VARCHAR) AS event_id, bool_or(o_orderkey % 3 = 0 AND {_DOWNLOADED} IN ('ok', 'skipped')) AS has FROM orders GROUP BY ALL), f AS (SELECT DISTINCT event_id, true AS facts FROM facts) "
    "SELECT event_id, array_to_string(list_filter([CASE WHEN NOT has THEN 'missing_14d9' END, CASE WHEN facts IS NULL THEN 'no_facts' END], lambda x: x IS NOT NULL), ',') AS exceptions, CASE WHEN facts IS NULL THEN 'failed' ELSE 'ok' END AS status FROM o LEFT JOIN f USING (event_id)",
)
def rep_exceptions(spark, sf_dir):
    return st.rep_tables(_reps(spark, sf_dir), "tender")["reps"].select("event_id", F.array_join("exceptions", ",").alias("exceptions"), "status")


@query("flat_spans", f"WITH {_MENTIONS} SELECT accession, field, row_number() OVER (PARTITION BY accession, field ORDER BY pos) - 1 AS pos, value, score FROM mentions")
def flat_spans(spark, sf_dir):
    m = mentions(spark, sf_dir)
    lists = m.groupBy("accession", "field").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value", "score"))), lambda x: F.struct(x["value"].alias("value"), x["score"].alias("score"))).alias("spans"))
    predictions = lists.groupBy("accession").agg(F.map_from_entries(F.collect_list(F.struct("field", "spans"))).alias("candidates"))
    return longs(sinks.flat_spans(predictions).select("accession", "field", "pos", "value", "score"))


@query("report_sections", f"WITH {RECORDS} SELECT 'forms' AS section, form, count(*) AS n, NULL AS ending FROM docs GROUP BY form UNION ALL SELECT 'endings', NULL, count(*), doc_ext FROM docs GROUP BY doc_ext")
def report_sections(spark, sf_dir):
    d = documents(spark, sf_dir)
    return sinks.sections({"forms": d.groupBy("form").agg(F.count(F.lit(1)).alias("n")), "endings": d.groupBy(F.col("doc_ext").alias("ending")).agg(F.count(F.lit(1)).alias("n"))})


_HIT_FORMS = ["SC TO-T", "SC TO-T/A", "S-4", "8-K"]
_FAMILY = "CASE form " + " ".join(f"WHEN '{f}' THEN '{FORM_FAMILIES[f]}'" for f in _HIT_FORMS if f in FORM_FAMILIES) + " ELSE 'other' END"


@query(
    "hits_to_records",
    f"""WITH h AS (SELECT o_orderkey AS k, o_custkey AS c, [{", ".join(f"'{f}'" for f in _HIT_FORMS)}][o_orderkey % 4 + 1] AS form, CAST(o_orderdate AS DATE) AS d FROM orders)
    SELECT k || ':' || CASE WHEN k % 3 = 0 THEN 'a.htm' ELSE 'ex99.txt' END AS hit_id, CAST(k AS VARCHAR) AS accession, CASE WHEN k % 3 = 0 THEN 'a.htm' ELSE 'ex99.txt' END AS filename, form, {_FAMILY} AS form_family,
      CASE WHEN k % 7 = 0 THEN NULL ELSE strftime(d, '%Y-%m-%d') END AS file_date, CASE WHEN k % 5 = 0 THEN NULL ELSE k % 9 END AS sequence, 'Customer ' || c || ' plc' AS entity_name, CASE WHEN c % 2 = 0 THEN 'AB' || c || '|CD' ELSE '' END AS tickers,
      lpad(CAST(c AS VARCHAR), 10, '0') AS primary_cik, CASE WHEN k % 4 < 3 THEN '005-' || c END AS primary_file_num, ends_with(form, '/A') AS is_amendment, k % 3 <> 0 AS is_exhibit, k % 3 = 0 AS is_primary_form_doc FROM h""",
)
def hits_to_records(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    form = F.get(F.array(*[F.lit(f) for f in _HIT_FORMS]), (k % 4).cast("int"))
    name = F.when(k % 3 == 0, "a.htm").otherwise("ex99.txt")
    cik = F.lpad(c.cast("string"), 10, "0")
    tickers = F.when(c % 2 == 0, F.concat(F.lit("  (AB"), c.cast("string"), F.lit(", CD)"))).otherwise("")
    shown = F.concat(F.lit("Customer "), c.cast("string"), F.lit(" plc"), tickers, F.lit("  (CIK "), cik, F.lit(")"))
    source = F.struct(
        k.cast("string").alias("adsh"), form.alias("form"), F.array(form).alias("root_forms"), F.when(k % 3 == 0, form).otherwise("EX-99.1").alias("file_type"), F.lit("a file").alias("file_description"),
        F.when(k % 7 == 0, "someday").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("file_date"), F.when(k % 5 == 0, "n/a").otherwise((k % 9).cast("string")).alias("sequence"), F.when(c % 3 == 0, F.array(cik)).alias("ciks"),
        F.array(shown).alias("display_names"), F.when(k % 4 < 3, F.array(F.concat(F.lit("005-"), c.cast("string")))).otherwise(F.array().cast("array<string>")).alias("file_num"),
        *[F.array().cast("array<string>").alias(x) for x in ("biz_states", "inc_states", "sics")], F.lit("").alias("xsl"),
    )
    hits = table(spark, sf_dir, "orders").select(F.concat_ws(":", k.cast("string"), name).alias("_id"), source.alias("_source"))
    path = sinks.work_folder(spark, "hits")
    hits.write.json(path)
    r = co.records_from_hits(readers.read_hits(spark, path))
    return longs(r.select("hit_id", "accession", "filename", "form", "form_family", F.col("file_date").cast("string").alias("file_date"), "sequence", "entity_name", F.array_join("tickers", "|").alias("tickers"), "primary_cik", "primary_file_num", "is_amendment", "is_exhibit", "is_primary_form_doc"))


@query("screened_rows", "SELECT doc_id AS accession FROM documents WHERE regexp_matches(text, '(?i)licen[sc]e')")
def screened_rows(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    found = F.when(F.col("text").rlike("(?i)licen[sc]e"), "merger_event_language_found").otherwise("no_event_language")
    return se.screened(d.select(F.col("doc_id").alias("accession"), F.lit("2024-01-01").alias("filing_date"), found.alias("screen_status"))).select("accession")


@query("period_filter", "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1994-01-01' AND DATE '1995-06-17' AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def period_filter(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return se.in_period(o, "1994-01-01", "1995-06-17", ("1-URGENT", "2-HIGH"), "o_orderdate", "o_orderpriority").select("o_orderkey")


@query(
    "valid_values",
    "WITH v AS (SELECT p_partkey AS k, ['ticker', 'cusip', 'isin', 'cash_consideration'][p_partkey % 4 + 1] AS field, CASE p_partkey % 3 WHEN 0 THEN upper(substr(p_name, 1, 4)) WHEN 1 THEN lpad(CAST(p_partkey AS VARCHAR), 9, '0') ELSE 'US' || lpad(CAST(p_partkey AS VARCHAR), 10, '0') END AS value, CASE WHEN p_partkey % 5 = 0 THEN 'a Par  value of' ELSE p_name END AS nearby FROM part) "
    "SELECT k FROM v WHERE CASE field WHEN 'ticker' THEN regexp_matches(value, '^[A-Z]{1,5}(\\.[A-Z])?$') WHEN 'cusip' THEN regexp_matches(value, '^[0-9A-Z]{9}$') WHEN 'isin' THEN regexp_matches(value, '^[A-Z]{2}[0-9A-Z]{10}$') ELSE true END AND NOT (field = 'cash_consideration' AND regexp_matches(nearby, '(?i)par\\s+value|exercise\\s+price|market\\s+price'))",
)
def valid_values(spark, sf_dir):
    k = F.col("p_partkey")
    field = F.get(F.array(*[F.lit(x) for x in ("ticker", "cusip", "isin", "cash_consideration")]), (k % 4).cast("int"))
    number = lambda n: F.lpad(k.cast("string"), n, "0")
    value = F.when(k % 3 == 0, F.upper(F.substring("p_name", 1, 4))).when(k % 3 == 1, number(9)).otherwise(F.concat(F.lit("US"), number(10)))
    nearby = F.when(k % 5 == 0, "a Par  value of").otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").where(sp.valid_merger_value(field, value, nearby)).select(k.alias("k"))


@query("filing_exhibits", f"WITH {RECORDS} SELECT DISTINCT accession, filename FROM docs WHERE form = '8-K' AND filename IS NOT NULL AND format_guess IN ('html', 'text') AND (is_exhibit OR starts_with(upper(file_type), 'EX-')) AND NOT starts_with(upper(file_type), 'EX-101')")
def filing_exhibits(spark, sf_dir):
    d = documents(spark, sf_dir)
    return se.filing_exhibits(d, d.where("form = '8-K'")).select("accession", "filename")


@query("exhibit_candidates", f"WITH {RECORDS} SELECT accession, file_description AS name, file_type AS type FROM docs WHERE contains(lower(file_type), 'ex-99') OR contains(replace(lower(file_description), '.', ''), 'ex99') OR contains(lower(file_description), 'offer') OR contains(lower(file_description), 'transmittal')")
def exhibit_candidates(spark, sf_dir):
    index = documents(spark, sf_dir).groupBy("accession").agg(F.collect_list(F.struct(F.col("file_description").alias("name"), F.col("file_type").alias("type"))).alias("items"))
    return se.exhibit_candidates(index)


@query("event_signals", f"WITH {EVENTS}, f AS (SELECT event_id, bool_or(file_description = 'Offer to Purchase') AS offer_price FROM docs GROUP BY event_id) SELECT f.event_id, offer_price, primary_form_family, has_amendment, true AS corporate_action_type_meta, len(tickers) > 0 AS ticker_meta, coalesce(primary_entity, '') <> '' AS security_description_meta, has_amendment AS notification_status_meta, primary_form_family AS primary_form_family_m FROM f JOIN evs USING (event_id)")
def event_signals(spark, sf_dir):
    d = documents(spark, sf_dir)
    flags = d.groupBy("event_id").agg(F.bool_or(F.col("file_description") == "Offer to Purchase").alias("offer_price"))
    return se.with_signals(flags, events(spark, sf_dir))


@query("reference_coverage", "WITH r AS (SELECT o_custkey AS a FROM orders), k AS (SELECT a, count(*) AS n FROM r GROUP BY a) SELECT CAST(sum(n) AS BIGINT) AS reference_rows, count(*) AS reference_accessions, count(*) FILTER (a % 3 <> 0) AS in_archive, count(*) FILTER (a % 4 = 1) AS selected, count(*) FILTER (a % 3 = 0) AS missing FROM k")
def reference_coverage(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_custkey").cast("string").alias("accession"))
    return ev.reference_coverage(o.select(F.concat(F.col("o_custkey").cast("string"), F.lit(" ")).alias("accession")), c.where("k % 3 <> 0"), c.where("k % 4 = 1"))


@query(
    "event_snapshot",
    f"WITH {RECORDS}, e AS (SELECT event_id, count(*) FILTER (sequence > 1) AS n_segments, count(*) FILTER (sequence = 2) AS n_priority_section, count(*) FILTER (sequence = 3) AS n_toc_section, count(*) FILTER (sequence = 4) AS n_faq, count(*) FILTER (sequence > 4) AS n_full_doc, count(*) FILTER (is_amendment) AS n_facts FROM docs GROUP BY event_id) SELECT * FROM e",
)
def event_snapshot(spark, sf_dir):
    d = documents(spark, sf_dir)
    s = F.col("sequence")
    segments = d.where("sequence > 1").select("event_id", F.when(s == 2, "priority_section").when(s == 3, "toc_section").when(s == 4, "faq").otherwise("full_doc").alias("segment_kind"))
    gates = d.select("event_id").distinct().select("event_id", F.lit(True).alias("ok"), F.lit("").alias("top1_offer_price"), F.lit("").alias("top1_offeror"))
    return rp.event_snapshot(d.select("event_id").distinct(), segments, d.where("is_amendment"), gates).drop("ok", "top1_offer_price", "top1_offeror")


@query("length_by_form_status", f"WITH {RECORDS} SELECT form, is_amendment, count(sequence) AS count, round(avg(sequence), 6) AS mean, CAST(min(sequence) AS DOUBLE) AS min, CAST(max(sequence) AS DOUBLE) AS max FROM docs GROUP BY ALL")
def length_by_form_status(spark, sf_dir):
    d = described(documents(spark, sf_dir), "sequence", "form", "is_amendment")
    return d.select("form", "is_amendment", F.col("n").cast("long").alias("count"), F.round("mean", 6).alias("mean"), F.col("min").cast("double").alias("min"), F.col("max").cast("double").alias("max"))


@query("folder_spread", f"WITH {RECORDS} SELECT form AS folder, count(*) AS n, count(DISTINCT nullif(lower(trim(entity_name)), '')) AS n_entities, count(DISTINCT year(file_date)) AS n_years FROM docs GROUP BY form")
def folder_spread(spark, sf_dir):
    return se.folder_spread(documents(spark, sf_dir).select(F.col("form").alias("folder"), "entity_name", F.year("file_date").alias("year")), "folder", "entity_name", "year")


@query("string_agreement", f"WITH {_PAIRS}, k AS (SELECT row_id, regexp_replace(lower(gold), '[^a-z0-9]+', '', 'g') AS r, regexp_replace(lower(predicted), '[^a-z0-9]+', '', 'g') AS p, regexp_replace(lower(gold || a), '[^a-z0-9]+', '', 'g') AS q FROM pairs) SELECT row_id, CASE WHEN r = '' THEN NULL WHEN p = r OR q = r THEN 'exact_normalized' WHEN (least(length(p), length(r)) >= 8 AND least(length(p), length(r)) >= 0.6 * greatest(length(p), length(r)) AND (contains(p, r) OR contains(r, p))) OR (least(length(q), length(r)) >= 8 AND least(length(q), length(r)) >= 0.6 * greatest(length(q), length(r)) AND (contains(q, r) OR contains(r, q))) THEN 'subphrase' END AS agreement FROM k")
def string_agreement(spark, sf_dir):
    status = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), "o_orderstatus")
    p = _pairs(spark, sf_dir).join(status, "row_id")
    return p.select("row_id", tx.string_agreement(F.col("gold"), F.array("predicted", F.concat("gold", "o_orderstatus"))).alias("agreement"))


@query("weak_families", f"WITH {_MENTIONS} SELECT accession AS event_id, coalesce(bool_and(NOT regexp_matches(value, '\\$\\s*[0-9,]+')) FILTER (field = 'click'), false) AS weak_price, coalesce(bool_and(true) FILTER (field = 'view'), false) AS weak_date FROM mentions GROUP BY accession")
def weak_families(spark, sf_dir):
    names = F.create_map(*[F.lit(x) for x in ("click", "offer_price", "view", "expiration_date")])
    m = mentions(spark, sf_dir).select(F.col("accession").alias("event_id"), F.coalesce(names[F.col("field")], F.lit("other")).alias("field_hint"), F.col("value").alias("text"))
    return sp.weak_families(m).select("event_id", "weak_price", "weak_date")


@query("two_pass_spans", "WITH e AS (SELECT CAST(user_id AS VARCHAR) AS event_id, event_id AS segment_id, event_type FROM events), w AS (SELECT event_id, bool_and(event_type <> 'click') FILTER (event_type IN ('click', 'view')) AS weak FROM e GROUP BY event_id) SELECT segment_id, 'first' AS pass FROM e WHERE event_type IN ('click', 'view') UNION ALL SELECT segment_id, 'second' FROM e JOIN w USING (event_id) WHERE event_type = 'purchase' OR weak")
def two_pass_spans(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("event_id"), F.col("event_id").alias("segment_id"), "event_type")
    segments = e.select("event_id", "segment_id", (F.col("event_type") == "purchase").alias("priority"), F.lit("full_doc").alias("kind"))
    text = F.when(F.col("event_type") == "click", "$5.00").otherwise("the price")
    spans = e.select("event_id", "segment_id", F.lit("offer_price_amount").alias("label"), text.alias("text"), F.lit(0.5).alias("score"), F.lit("").alias("doc_role"), F.lit("").alias("segment_kind"), F.lit(False).alias("priority"), "event_type")
    out = sp.two_pass(segments, spans.where("event_type in ('click', 'view')").withColumn("pass", F.lit("first")), spans.withColumn("pass", F.lit("second")))
    return out.select("segment_id", "pass")


@query("review_cells", "SELECT CAST(s_suppkey AS VARCHAR) AS accession, f.field, f.v AS reference_value, '' AS gold_value, '' AS review_status FROM supplier, LATERAL (VALUES ('target', s_name), ('ticker', upper(s_name))) f(field, v)")
def review_cells(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("accession"), F.col("s_name").alias("target"), F.upper("s_name").alias("ticker"))
    return ev.review_cells(s, ("target", "ticker")).select("accession", "field", "reference_value", "gold_value", "review_status")


_TRACK_FORMS = ", ".join(f"('{t}', '{f}')" for t in TRACKS for f in TRACKS[t][1])


@query(
    "work_list",
    f"WITH t(track, form) AS (VALUES {_TRACK_FORMS}), m AS (SELECT track, form, greatest(CAST(unnest(generate_series(DATE '2020-01-01', DATE '2020-12-20', INTERVAL 1 MONTH)) AS DATE), DATE '2020-01-15') AS s FROM t), w AS (SELECT *, least(last_day(s), DATE '2020-12-20') AS e FROM m), "
    "d AS (SELECT DISTINCT month(CAST(o_orderdate AS DATE)) AS m FROM orders WHERE o_orderkey % 1000 < 40) SELECT track, form, CAST(s AS VARCHAR) AS window_start, CAST(e AS VARCHAR) AS window_end FROM w WHERE NOT (month(s) IN (SELECT m FROM d) AND form = 'SC TO-T' AND track = 'tender')",
)
def work_list(spark, sf_dir):
    """The windows of 2020 still to be fetched, where some months of one form (those of some orders) are done."""
    month = table(spark, sf_dir, "orders").where("o_orderkey % 1000 < 40").select(F.make_date(F.lit(2020), F.month("o_orderdate"), F.lit(1)).alias("m")).distinct()
    first, last = F.greatest("m", F.lit("2020-01-15").cast("date")), F.least(F.last_day("m"), F.lit("2020-12-20").cast("date"))
    done = month.select(F.concat_ws("|", F.lit("SC TO-T"), first.cast("string"), last.cast("string")).alias("key"))
    w = readers.work_list(spark, "2020-01-15", "2020-12-20", done)
    return w.select("track", "form", F.col("window_start").cast("string").alias("window_start"), F.col("window_end").cast("string").alias("window_end"))


@query("fresh_first", "SELECT o_orderkey, o_orderkey % 3 = 0 AS is_done FROM orders ORDER BY is_done, o_orderkey LIMIT 400")
def fresh_first(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return st.fresh_first(o, o.where("o_orderkey % 3 = 0"), "o_orderkey", 400)


@query("with_failures", "SELECT doc_id, CASE WHEN length(text) < 200 THEN 'short' WHEN contains(text, '!!') THEN 'loud' END AS error, CASE WHEN length(text) < 200 OR contains(text, '!!') THEN 'failed' ELSE 'ok' END AS status FROM documents")
def with_failures(spark, sf_dir):
    return st.with_failures(table(spark, sf_dir, "documents"), "doc_id", {"short": F.length("text") < 200, "loud": F.contains("text", F.lit("!!"))}).select("doc_id", "error", "status")


@query("resumed_stage", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'failed' ELSE 'ok' END AS status FROM customer UNION ALL SELECT c_custkey, 'failed' FROM customer WHERE c_custkey % 5 = 0 AND c_custkey <= (SELECT max(c_custkey) FROM (SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 40))")
def resumed_stage(spark, sf_dir):
    """A stage that runs for 40 keys, then for the rest and for those that failed."""
    runner = st.Runner(spark, sinks.work_folder(spark, "stages"), "c_custkey")
    source = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    stage = st.Stage("clean", lambda df: st.with_failures(df, "c_custkey", {"fifth": F.col("c_custkey") % 5 == 0}))
    runner.run(stage, source, limit=40)
    runner.run(stage, source)
    return runner.table("clean").select("c_custkey", "status")


@query("streamed_events", "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY event_type")
def streamed_events(spark, sf_dir):
    """The events as a stream of files, appended once for each key; the second run finds nothing new."""
    root = sinks.work_folder(spark, "stream")
    source = table(spark, sf_dir, "events")
    source.union(source.where("event_id % 10 = 0")).repartition(4).write.parquet(f"{root}/in")
    for run in ("a", "b"):  # another checkpoint reads all files again
        stream = ingest.deduplicated(ingest.file_stream(spark, f"{root}/in", source.schema, 2), "event_id", "ts")
        ingest.run_available(stream, f"{root}/out", f"{root}/check-{run}", "event_id")
    return spark.read.parquet(f"{root}/out").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


def _stage_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The stages' tables, from documents and events that are made once and written."""
    root = sinks.work_folder(spark, "stages")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{root}/{name}")
        return spark.read.parquet(f"{root}/{name}")

    d = kept(documents(spark, sf_dir).select("event_id", "accession", F.col("hit_id").alias("filename"), "sequence", "is_amendment", "form"), "documents")
    e = kept(events(spark, sf_dir).select("event_id", "n_documents", "has_amendment"), "events")
    s = F.col("sequence")
    return {
        "inventory": d.select("event_id", "accession", "filename"),
        "raw": d.where("sequence <> 6").select("accession", "filename", F.when((s == 4) & (F.col("form") == "8-K"), 0).otherwise(10).alias("n_bytes")),
        "clean": d.where("sequence <> 5").select("accession", "filename"),
        "segments": e.where("n_documents > 2").select("event_id", (F.col("n_documents") - 3).alias("n_segments")),
        "spans": e.select("event_id", F.when(F.col("has_amendment"), "ok").otherwise("failed").alias("status"), F.lit(0).alias("n_spans")),
        "reps": e.where("n_documents > 5").select("event_id", F.when(F.col("n_documents") % 2 == 0, "ok").otherwise("failed").alias("status")),
    }


@query(
    "stage_readiness",
    f"WITH {EVENTS}, d AS (SELECT event_id, bool_and(sequence <> 6 AND NOT (sequence = 4 AND form = '8-K')) AS download, bool_or(sequence <> 6) AND bool_and(sequence <> 5 OR sequence = 6) AS cleanup FROM docs GROUP BY event_id) SELECT event_id, download, cleanup, n_documents > 3 AS segment, has_amendment AS spans, n_documents > 5 AND n_documents % 2 = 0 AS assemble, true AS inventory, n_documents > 5 AND n_documents % 2 = 0 AS load FROM d JOIN evs USING (event_id)",
)
def stage_readiness(spark, sf_dir):
    return se.stage_readiness(**_stage_tables(spark, sf_dir))


@query("download_manifest", f"WITH {RECORDS} SELECT hit_id AS filename, CASE WHEN sequence <> 6 AND NOT (sequence = 4 AND form = '8-K') THEN 'skipped' WHEN form = '8-K' THEN 'failed' ELSE 'pending' END AS status, CASE WHEN NOT (sequence <> 6 AND NOT (sequence = 4 AND form = '8-K')) AND form = '8-K' THEN 'timeout' END AS error FROM docs")
def download_manifest(spark, sf_dir):
    t = _stage_tables(spark, sf_dir)
    results = documents(spark, sf_dir).where("form = '8-K'").select("accession", F.col("hit_id").alias("filename"), F.lit("failed").alias("status"), F.lit("timeout").alias("error"))
    return se.download_manifest(t["inventory"], t["raw"], results).select("filename", "status", "error")


@query("stub_parents", f"WITH {EVENTS} SELECT event_id, CASE WHEN n_documents > 4 THEN n_documents END AS n_documents FROM evs")
def stub_parents(spark, sf_dir):
    held = events(spark, sf_dir).where("n_documents > 4").select("event_id", "n_documents")
    return se.with_stub_events(held, documents(spark, sf_dir))


@query("lost_events", f"WITH {EVENTS} SELECT event_id, n_documents FROM evs WHERE n_documents <= 4")
def lost_events(spark, sf_dir):
    return ds.orphans(documents(spark, sf_dir), events(spark, sf_dir).where("n_documents > 4"))


@query("text_inputs", "SELECT CAST(doc_id % 500 AS VARCHAR) AS accession, count(*) AS reference_records, CASE WHEN min(doc_id % 500) % 3 = 0 THEN 'missing' WHEN min(doc_id % 500) % 3 = 1 THEN 'changed' ELSE 'ok' END AS status FROM documents GROUP BY ALL")
def text_inputs(spark, sf_dir):
    k = F.col("doc_id") % 500
    digest = F.sha2(F.encode(k.cast("string"), "UTF-8"), 256)
    d = table(spark, sf_dir, "documents").select(k.cast("string").alias("accession"), F.when(k % 3 == 1, "old").otherwise(digest).alias("input_hash"))
    texts = d.select("accession").distinct().where("cast(accession as long) % 3 <> 0").withColumn("text", F.col("accession"))
    return se.text_inputs(d, texts).select("accession", "reference_records", "status")


@query("collapsed_text", "SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[\\s\\x0B\\x85\\p{Z}]+', ' ', 'g')) AS text FROM documents")
def collapsed_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", se.collapsed(F.col("text")).alias("text"))



@query(
    "gated_dates",
    """WITH m AS (SELECT CAST(o_custkey AS VARCHAR) AS accession, o_orderkey AS pos, round(o_totalprice / 1000000, 6) AS score,
      CASE o_orderkey % 4 WHEN 0 THEN 'The special meeting is on ' WHEN 1 THEN 'Nothing of the kind on ' WHEN 2 THEN repeat('filler ', 20) || 'on ' ELSE 'special meeting' || repeat(' filler', 30) || ' on ' END AS lead, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS value FROM orders)
    SELECT accession, value, score, pos FROM m WHERE score >= 0.4 AND lead LIKE 'The special meeting%' QUALIFY row_number() OVER (PARTITION BY accession ORDER BY score DESC, pos) = 1""",
)
def gated_dates(spark, sf_dir):
    k = F.col("o_orderkey")
    lead = F.when(k % 4 == 0, "The special meeting is on ").when(k % 4 == 1, "Nothing of the kind on ").when(k % 4 == 2, "filler " * 20 + "on ").otherwise("special meeting" + " filler" * 30 + " on ")
    m = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("accession"), F.lit("shareholder_vote_date").alias("field"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("value"), F.round(F.col("o_totalprice") / 1000000, 6).alias("score"), k.alias("pos"), lead.alias("lead"))
    m = m.select("*", (F.length("lead") + 500).alias("start"), F.lit(500).alias("quote_start"), F.concat("lead", "value", F.lit(".")).alias("source_quote"))
    return sp.gated_dates(m, ["accession"]).select("accession", "value", "score", "pos")


@query(
    "demoted_ranks",
    """WITH s AS (SELECT CAST(user_id AS VARCHAR) AS event_id, event_id AS span_id, event_type AS t, CASE event_type WHEN 'click' THEN 'offeror' WHEN 'view' THEN 'target' WHEN 'purchase' THEN 'ticker' ELSE 'security_description' END AS h,
      CASE event_type WHEN 'click' THEN CASE WHEN event_id % 3 = 0 THEN 'Buyer Holdings Inc.' ELSE 'Bo' END WHEN 'view' THEN CASE WHEN event_id % 4 = 0 THEN 'Tango ABC Works Corp.' WHEN event_id % 4 = 1 THEN 'ABC' ELSE 'Some Target' END WHEN 'purchase' THEN 'ABC' ELSE CASE WHEN event_id % 2 = 0 THEN 'Stk' ELSE 'Common shares of the company' END END AS x FROM events),
    g AS (SELECT event_id, bool_or(h = 'offeror' AND x LIKE 'Buyer%') AS legal_offeror, bool_or(h = 'target' AND x LIKE 'Tango%') AS legal_target, bool_or(h = 'security_description' AND length(x) > 12) AS strong, bool_or(h = 'ticker') AS tick, count(*) FILTER (h = 'target' AND x = 'ABC') AS lone FROM s GROUP BY event_id)
    SELECT span_id, round(1.0 - CASE WHEN h = 'offeror' AND legal_offeror AND x = 'Bo' THEN 0.4 WHEN h = 'target' AND legal_target AND x = 'ABC' THEN 0.4 ELSE 0 END - CASE WHEN h = 'security_description' AND strong AND x = 'Stk' THEN 0.35 ELSE 0 END
      - CASE WHEN h = 'target' AND x = 'ABC' AND tick THEN 0.3 ELSE 0 END + CASE WHEN h = 'target' AND x LIKE 'Tango%' AND tick THEN 0.15 * lone ELSE 0 END, 6) AS rank_score FROM s JOIN g USING (event_id)""",
)
def demoted_ranks(spark, sf_dir):
    k, t = F.col("event_id"), F.col("event_type")
    hint = F.when(t == "click", "offeror").when(t == "view", "target").when(t == "purchase", "ticker").otherwise("security_description")
    target = F.when(k % 4 == 0, "Tango ABC Works Corp.").when(k % 4 == 1, "ABC").otherwise("Some Target")
    text = F.when(t == "click", F.when(k % 3 == 0, "Buyer Holdings Inc.").otherwise("Bo")).when(t == "view", target).when(t == "purchase", "ABC").otherwise(F.when(k % 2 == 0, "Stk").otherwise("Common shares of the company"))
    s = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("event_id"), k.alias("span_id"), hint.alias("field_hint"), text.alias("text"), F.lit("").alias("passage"), F.lit(1.0).alias("rank_score"))
    return sp.demoted(s).select("span_id", F.round("rank_score", 6).alias("rank_score"))


@query("exported_archive", f"WITH {_EVIDENCE}, {_QUEUE} SELECT CAST(queue.accession AS VARCHAR) AS accession, text_sha256, suggested_priority, evidence_types, substr(text, 1, 4) AS confirmed_evidence, length(text) AS n_chars FROM queue JOIN screened ON queue.accession = screened.accession WHERE queue.accession % 5 = 0")
def exported_archive(spark, sf_dir):
    """A fifth of the queue confirmed by its first words, exported, and manifest and texts read back."""
    folder, s = sinks.work_folder(spark, "export"), _screened(spark, sf_dir)
    fifth = F.col("accession") % 5 == 0
    q = ev.screen(s).join(s.select("accession", F.substring("text", 1, 4).alias("quote")), "accession")
    q = q.withColumn("review_label", F.when(fifth, "confirmed").otherwise("")).withColumn("confirmed_evidence", F.col("quote")).withColumn("reviewed_at", F.lit("2024-05-01")).drop("quote")
    rp.export_confirmed(q, s, ev.stale_reviews(q, s), folder)
    texts = readers.read_json_lines(spark, f"{folder}/documents", "accession long, text string").select(F.col("accession").cast("string").alias("accession"), F.length("text").cast("long").alias("n_chars"))
    return readers.read_csv(spark, f"{folder}/manifest").join(texts, "accession").select("accession", "text_sha256", "suggested_priority", F.coalesce("evidence_types", F.lit("")).alias("evidence_types"), "confirmed_evidence", "n_chars")
