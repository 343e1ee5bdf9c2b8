"""Corpus, overview, amendment, quality and datastore queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import value_counts
from ..functions.quantiles import described
from ..functions.text import text_measures
from ..operators import amendments as am
from ..operators import corpus as co
from ..operators import datastore as ds
from ..operators import mvp
from ..operators import priority as pr
from ..operators import quality as qa
from ..operators import sampling as sa
from ..registry import query
from .surrogate import EVENTS, RECORDS, TAGGED, VERSIONS, documents, events, records, table

JOINED = ("forms", "form_families", "entity_names", "ciks", "tickers")


def joined(df: DataFrame) -> DataFrame:
    return df.select(*[F.array_join(c, "|").alias(c) if c in JOINED else F.col(c) for c in df.columns])


def longs(df: DataFrame) -> DataFrame:
    """Whole numbers as long and dates as text, so that both engines show them alike."""
    kinds = {"int": "long", "smallint": "long", "date": "string"}
    return df.select(*[F.col(c).cast(kinds.get(t, t)).alias(c) if t in kinds else F.col(c) for c, t in df.dtypes])


_LISTS = ", ".join(f"coalesce(array_to_string({c}, '|'), '') AS {c}" for c in JOINED) + ", CAST(first_file_date AS VARCHAR) AS first_file_date, CAST(last_file_date AS VARCHAR) AS last_file_date"


@query("event_rollup", f"WITH {EVENTS} SELECT * REPLACE ({_LISTS}) FROM evs")
def event_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(joined(events(spark, sf_dir)))


@query("document_table", f"WITH {RECORDS} SELECT hit_id, event_id, form, form_family, doc_ext, format_guess, is_amendment, is_exhibit, is_primary_form_doc FROM docs")
def document_table(spark, sf_dir):
    return documents(spark, sf_dir).select("hit_id", "event_id", "form", "form_family", "doc_ext", "format_guess", "is_amendment", "is_exhibit", "is_primary_form_doc")


@query("first_seen_hits", f"WITH {RECORDS} SELECT accession, sequence, hit_id FROM records QUALIFY row_number() OVER (PARTITION BY accession, sequence ORDER BY hit_id) = 1")
def first_seen_hits(spark, sf_dir):
    keyed = records(spark, sf_dir).withColumn("key", F.concat_ws("|", "accession", "sequence"))
    return co.first_seen(keyed, "key", "hit_id").select("accession", "sequence", "hit_id")


@query("form_counts", f"WITH {RECORDS} SELECT form, count(*) AS n FROM docs GROUP BY form")
def form_counts(spark, sf_dir):
    return value_counts(documents(spark, sf_dir), "form")


@query("format_counts", f"WITH {RECORDS} SELECT format_guess, form_family, count(*) AS n_documents FROM docs GROUP BY ALL")
def format_counts(spark, sf_dir):
    return co.format_availability(documents(spark, sf_dir))


@query("page_formats", r"SELECT coalesce(nullif(regexp_extract(lower(url), '(\.[a-z0-9]+)$', 1), ''), '(none)') AS ending, count(*) AS n FROM pages GROUP BY ALL")
def page_formats(spark, sf_dir):
    ending = F.coalesce(F.nullif(F.regexp_extract(F.lower("url"), r"(\.[a-z0-9]+)$", 1), F.lit("")), F.lit("(none)"))
    return table(spark, sf_dir, "pages").groupBy(ending.alias("ending")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "dataset_overview",
    f"""WITH {EVENTS}, d AS (SELECT count(*) AS n_documents, count(DISTINCT accession) AS n_filings, count(DISTINCT primary_cik) AS n_issuers, min(file_date) AS a, max(file_date) AS b FROM docs),
    e AS (SELECT count(*) AS n_events, count(*) FILTER (has_amendment) AS n_amended_events, round(100 * avg(CAST(has_amendment AS INT)), 2) AS pct FROM evs)
    SELECT 'n_documents' AS metric, CAST(n_documents AS VARCHAR) AS value FROM d UNION ALL SELECT 'n_filings', CAST(n_filings AS VARCHAR) FROM d UNION ALL SELECT 'n_issuers', CAST(n_issuers AS VARCHAR) FROM d
    UNION ALL SELECT 'first_file_date', CAST(a AS VARCHAR) FROM d UNION ALL SELECT 'last_file_date', CAST(b AS VARCHAR) FROM d UNION ALL SELECT 'n_events', CAST(n_events AS VARCHAR) FROM e
    UNION ALL SELECT 'n_amended_events', CAST(n_amended_events AS VARCHAR) FROM e UNION ALL SELECT 'pct_amended_events', CAST(pct AS VARCHAR) FROM e""",
)
def dataset_overview(spark, sf_dir):
    d = documents(spark, sf_dir)
    return co.overview(d, co.event_table(d))


@query("monthly_volume", f"WITH {RECORDS} SELECT CAST(CAST(date_trunc('month', file_date) AS DATE) AS VARCHAR) AS month, form_family, count(*) AS n_documents FROM docs WHERE file_date IS NOT NULL GROUP BY ALL")
def monthly_volume(spark, sf_dir):
    return longs(co.monthly_volume(documents(spark, sf_dir)))


_DESCRIBE = "count({0}) AS n, avg({0}) AS mean, stddev_samp({0}) AS std, CAST(min({0}) AS DOUBLE) AS min, quantile_cont({0}, 0.25) AS p25, quantile_cont({0}, 0.5) AS p50, quantile_cont({0}, 0.75) AS p75, CAST(max({0}) AS DOUBLE) AS max"


@query("documents_per_event", f"WITH {EVENTS} SELECT {_DESCRIBE.format('n_documents')} FROM evs")
def documents_per_event(spark, sf_dir):
    return co.documents_per_event(events(spark, sf_dir))


@query("length_by_lang", f"SELECT lang, {_DESCRIBE.format('n_chars')} FROM documents GROUP BY lang")
def length_by_lang(spark, sf_dir):
    return described(table(spark, sf_dir, "documents"), "n_chars", "lang")


@query("text_measures", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[^\x09-\x0D\x20]+')) AS BIGINT) AS n_words, CAST(length(text) AS BIGINT) AS n_chars, CAST(strlen(text) AS BIGINT) AS n_bytes, round(len(regexp_extract_all(text, '[^\x09-\x0D\x20]+')) / 500, 2) AS pages, sha1(text) AS sha1 FROM documents")
def measures(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *text_measures(F.col("text")))


@query("shared_filenames", f"WITH {RECORDS} SELECT filename, count(DISTINCT accession) AS n_accessions, count(*) AS n_rows FROM docs GROUP BY filename HAVING count(DISTINCT accession) > 1")
def shared_filenames(spark, sf_dir):
    return co.shared_filenames(documents(spark, sf_dir))


@query("filing_table", f"WITH {RECORDS} SELECT event_id, accession, form, form_family, is_amendment, count(*) AS n_documents, CAST(min(file_date) AS VARCHAR) AS file_date FROM docs GROUP BY ALL")
def filing_table(spark, sf_dir):
    return longs(co.filing_table(documents(spark, sf_dir)))


@query("unusual_volume_top15", f"WITH {EVENTS} SELECT event_id, n_documents, n_filings FROM evs ORDER BY n_documents DESC, event_id LIMIT 15")
def unusual_volume(spark, sf_dir):
    return co.unusual_volume(events(spark, sf_dir)).select("event_id", "n_documents", "n_filings")


@query("issuer_counts", f"WITH {EVENTS} SELECT coalesce(primary_cik, primary_entity, 'unknown') AS issuer, count(*) AS n_events, CAST(sum(n_documents) AS BIGINT) AS n_documents FROM evs GROUP BY ALL")
def issuer_counts(spark, sf_dir):
    return co.issuer_counts(events(spark, sf_dir))


@query("repeated_issuers", f"WITH {EVENTS} SELECT coalesce(primary_cik, primary_entity, 'unknown') AS issuer, count(*) AS n_events, CAST(sum(n_documents) AS BIGINT) AS n_documents FROM evs GROUP BY ALL HAVING count(*) > 1")
def repeated_issuers(spark, sf_dir):
    return co.repeated_issuers(events(spark, sf_dir))


@query("event_versions", f"WITH {RECORDS}{VERSIONS} SELECT * REPLACE (CAST(file_date AS VARCHAR) AS file_date) FROM versions")
def event_versions(spark, sf_dir):
    return longs(am.event_versions(documents(spark, sf_dir)))


_LATEST = f"WITH {RECORDS}{VERSIONS} SELECT event_id, version_no, accession, version_status FROM versions QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY version_no DESC) = 1"


@query("latest_version_window", _LATEST)
def latest_version_window(spark, sf_dir):
    return longs(am.latest_version(am.event_versions(documents(spark, sf_dir)))).select("event_id", "version_no", "accession", "version_status")


@query("latest_version_lateral", _LATEST)
def latest_version_lateral(spark, sf_dir):
    d = documents(spark, sf_dir)
    return longs(am.latest_version_lateral(am.event_versions(d), d.select("event_id").distinct()))


@query(
    "filing_cadence",
    f"""WITH {RECORDS}, f AS (SELECT event_id, accession, form, is_amendment, min(file_date) AS file_date FROM docs GROUP BY ALL)
    SELECT * REPLACE (CAST(file_date AS VARCHAR) AS file_date), CAST(date_diff('day', lag(file_date) OVER w, file_date) AS BIGINT) AS days_since_prior_filing, CAST(date_diff('day', min(file_date) OVER (PARTITION BY event_id), file_date) AS BIGINT) AS days_since_first_filing
    FROM f WINDOW w AS (PARTITION BY event_id ORDER BY file_date NULLS LAST, accession, form, is_amendment)""",
)
def filing_cadence(spark, sf_dir):
    return longs(am.filing_cadence(documents(spark, sf_dir)))


@query("amendment_lag", f"WITH {EVENTS}, f AS (SELECT event_id, accession, min(file_date) AS file_date FROM docs WHERE is_amendment GROUP BY ALL) SELECT event_id, accession, CAST(date_diff('day', first_file_date, file_date) AS BIGINT) AS lag_days, n_filings FROM f LEFT JOIN evs USING (event_id)")
def amendment_lag(spark, sf_dir):
    d = documents(spark, sf_dir)
    f = d.where("is_amendment").groupBy("event_id", "accession").agg(F.min("file_date").alias("file_date"))
    return f.join(co.event_table(d), "event_id", "left").select("event_id", "accession", F.datediff("file_date", "first_file_date").cast("long").alias("lag_days"), "n_filings")


@query("simple_amendments", f"WITH {EVENTS} SELECT event_id, n_documents FROM evs WHERE n_amendment_filings = 1 ORDER BY n_documents, event_id LIMIT 10")
def simple_amendments(spark, sf_dir):
    return am.simple_amendments(events(spark, sf_dir)).select("event_id", "n_documents")


@query("complex_amendments", f"WITH {EVENTS} SELECT event_id, n_amendment_filings FROM evs WHERE has_amendment ORDER BY n_amendment_filings DESC, event_id LIMIT 10")
def complex_amendments(spark, sf_dir):
    return am.complex_amendments(events(spark, sf_dir)).select("event_id", "n_amendment_filings")


@query(
    "missing_metadata",
    f"WITH {RECORDS}, t AS (SELECT count(*) AS n FROM docs), m AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) FILTER ({c} IS NULL) AS n_missing_or_empty FROM docs" for c in qa.METADATA)
    + " UNION ALL SELECT 'tickers', count(*) FILTER (len(tickers) = 0) FROM docs) SELECT field, n_missing_or_empty, round(100 * n_missing_or_empty / n, 2) AS pct FROM m, t",
)
def missing_metadata(spark, sf_dir):
    return qa.missing_metadata(documents(spark, sf_dir))


@query("name_variance", f"WITH {RECORDS} SELECT primary_cik, count(DISTINCT entity_name) AS n_distinct_names FROM docs WHERE entity_name IS NOT NULL GROUP BY primary_cik HAVING count(DISTINCT entity_name) > 1")
def name_variance(spark, sf_dir):
    return qa.name_variance(documents(spark, sf_dir))


@query("duplicate_documents", f"WITH {RECORDS} SELECT accession, filename, count(*) AS n FROM docs GROUP BY ALL HAVING count(*) > 1")
def duplicate_documents(spark, sf_dir):
    return qa.duplicate_documents(documents(spark, sf_dir))


@query("near_duplicate_content", "SELECT sha1(coalesce(text, '')) AS sha1, count(*) AS n, count(DISTINCT source) AS n_groups, min(doc_id) AS first_key FROM documents GROUP BY ALL HAVING count(*) > 1")
def near_duplicate_content(spark, sf_dir):
    return qa.near_duplicate_content(table(spark, sf_dir, "documents"), "doc_id", "text", "source")


@query(
    "leakage_risks",
    f"""WITH {EVENTS} SELECT 'document_level_random_split' AS risk, count(*) AS affected_events, CAST(sum(n_documents) AS BIGINT) AS affected_documents FROM evs WHERE n_documents > 1
    UNION ALL SELECT 'issuer_repeated_across_splits', count(*), NULL FROM (SELECT primary_cik FROM evs GROUP BY primary_cik HAVING count(*) > 1)
    UNION ALL SELECT 'weak_event_key_without_file_num', (SELECT count(*) FROM evs WHERE starts_with(event_id, 'NO_FILE_NUM:')), (SELECT count(*) FROM docs WHERE starts_with(event_id, 'NO_FILE_NUM:'))""",
)
def leakage_risks(spark, sf_dir):
    return qa.leakage_risks(events(spark, sf_dir))


@query("event_tagging", f"WITH {TAGGED} SELECT event_id, has_to_t, has_to_i, has_14d9, has_file_num, event_type, in_core, in_preferred, in_stretch, amendment_band FROM tagged")
def event_tagging(spark, sf_dir):
    return mvp.tag_events(events(spark, sf_dir)).select("event_id", "has_to_t", "has_to_i", "has_14d9", "has_file_num", "event_type", "in_core", "in_preferred", "in_stretch", "amendment_band")


@query(
    "selection_funnel",
    f"""WITH {TAGGED} SELECT 'all_events' AS stage, count(*) AS n_events FROM tagged UNION ALL SELECT 'has_file_number', count(*) FILTER (has_file_num) FROM tagged UNION ALL SELECT 'core', count(*) FILTER (in_core) FROM tagged
    UNION ALL SELECT 'preferred', count(*) FILTER (in_preferred) FROM tagged UNION ALL SELECT 'preferred_with_amendments', count(*) FILTER (in_preferred AND has_amendment) FROM tagged UNION ALL SELECT 'stretch', count(*) FILTER (in_stretch) FROM tagged""",
)
def selection_funnel(spark, sf_dir):
    return mvp.selection_funnel(mvp.tag_events(events(spark, sf_dir)))


def _values(rows: list[tuple]) -> str:
    show = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else "[" + ", ".join(f"'{x}'" for x in v) + "]" if isinstance(v, list) else str(v)
    return "VALUES " + ", ".join("(" + ", ".join(show(v) for v in r) + ")" for r in rows)


_TYPES = _values([(k, list(p), list(s)) for k, (p, s) in mvp.EVENT_TYPES.items()])


@query(
    "corpus_gaps",
    f"""WITH {RECORDS}, types(event_type, p, s) AS ({_TYPES}), present AS (SELECT list(DISTINCT form) AS f FROM docs),
    j AS (SELECT *, list_sort(list_filter(p, lambda x: list_contains(f, x))) AS hit, list_sort(list_filter(s, lambda x: list_contains(f, x))) AS also, list_sort(list_filter(p, lambda x: NOT list_contains(f, x))) AS miss FROM types, present)
    SELECT event_type, coalesce(nullif(array_to_string(hit, ', '), ''), '(none)') AS primary_forms_in_corpus, coalesce(nullif(array_to_string(also, ', '), ''), '(none)') AS supporting_forms_in_corpus,
    coalesce(nullif(array_to_string(miss, ', '), ''), '(none)') AS missing_primary_forms, CAST(len(hit) AS BIGINT) AS n_primary_present, CAST(len(p) AS BIGINT) AS n_primary_target, round(100 * len(hit) / len(p), 1) AS primary_coverage_pct FROM j""",
)
def corpus_gaps(spark, sf_dir):
    return mvp.corpus_gaps(spark, documents(spark, sf_dir))


@query(
    "field_values_seed",
    f"""WITH {TAGGED}{VERSIONS}, latest AS (SELECT event_id, max(version_no) AS version_no FROM versions GROUP BY event_id), e AS (SELECT * FROM tagged JOIN latest USING (event_id))
    SELECT event_id, version_no, 'corporate_action_type' AS field_name, event_type AS value_text, NULL AS value_json, 'derived' AS method, 0.9::DOUBLE AS confidence FROM e
    UNION ALL SELECT event_id, version_no, 'security_description', primary_entity, NULL, 'metadata', 0.6 FROM e WHERE primary_entity IS NOT NULL
    UNION ALL SELECT event_id, version_no, 'ticker', tickers[1], '["' || array_to_string(tickers, '","') || '"]', 'metadata', 0.55 FROM e WHERE len(tickers) > 0
    UNION ALL SELECT event_id, version_no, 'notification_status', CASE WHEN has_amendment THEN 'AMENDED' ELSE 'ANNOUNCEMENT' END, NULL, 'derived', 0.5 FROM e
    UNION ALL SELECT event_id, version_no, f, NULL, NULL, 'placeholder', 0.0 FROM e, (VALUES ('processing_status'), ('eligible_quantity'), ('position_quantity'), ('debit_credit_indicator')) t(f) WHERE in_preferred""",
)
def field_values_seed(spark, sf_dir):
    d = documents(spark, sf_dir)
    out = ds.field_values(mvp.tag_events(co.event_table(d)), am.event_versions(d))
    return longs(out)


@query(
    "current_fields_view",
    f"""WITH {TAGGED}, v AS (SELECT event_id, 'notification_status' AS field_name, CASE WHEN has_amendment THEN 'AMENDED' ELSE 'ANNOUNCEMENT' END AS value_text FROM tagged)
    SELECT event_id, field_name, value_text, 'notification_metadata' AS field_group, 'derived_from_public' AS source_class, primary_entity, event_type FROM v JOIN tagged USING (event_id)""",
)
def current_fields_view(spark, sf_dir):
    d = documents(spark, sf_dir)
    e = mvp.tag_events(co.event_table(d))
    values = ds.field_values(e, am.event_versions(d)).where("field_name = 'notification_status'").select("event_id", "field_name", "value_text")
    return ds.current_fields(e, values, mvp.field_table(spark))


@query(
    "upsert_customers",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new ' || c_name ELSE c_name END AS c_name, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 1.5 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 5 <> 0
    UNION ALL SELECT c_custkey, 'new ' || c_name, CASE WHEN c_custkey % 2 = 0 THEN 1.5 END, 'X' FROM customer WHERE c_custkey % 5 = 0 AND c_custkey % 3 = 0""",
)
def upsert_customers(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    new = c.where("c_custkey % 3 = 0").select("c_custkey", F.concat(F.lit("new "), "c_name").alias("c_name"), F.when(F.col("c_custkey") % 2 == 0, 1.5).alias("c_acctbal"), F.lit("X").alias("c_mktsegment"))
    return ds.upsert(c.where("c_custkey % 5 <> 0"), new, ["c_custkey"], keep=["c_mktsegment"], fill=["c_acctbal"])


@query("insert_missing", "SELECT o_custkey AS id, CASE WHEN o_custkey % 2 = 0 THEN 'old' ELSE 'new' END AS state FROM (SELECT DISTINCT o_custkey FROM orders)")
def insert_missing(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))
    return ds.insert_missing(ids.distinct().where("id % 2 = 0").withColumn("state", F.lit("old")), ids.withColumn("state", F.lit("new")), ["id"])


@query("orphan_documents", "SELECT CAST(l_orderkey AS VARCHAR) AS event_id, count(*) AS n_documents FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY ALL")
def orphan_documents(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("event_id"))
    return ds.orphans(d, table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").cast("string").alias("event_id")))


@query(
    "latest_sample_join",
    f"""WITH {RECORDS}, s AS (SELECT accession, filename, hit_id, CASE WHEN is_exhibit THEN 'empty' ELSE 'ok' END AS status, sha1(hit_id) AS content_sha1 FROM docs WHERE sequence % 2 = 0),
    last AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY accession, filename ORDER BY hit_id DESC) = 1)
    SELECT docs.hit_id, docs.accession, docs.filename, status, content_sha1 FROM docs LEFT JOIN last USING (accession, filename)""",
)
def latest_sample_join(spark, sf_dir):
    d = documents(spark, sf_dir)
    s = d.where("sequence % 2 = 0").select("accession", "filename", "hit_id", F.when(F.col("is_exhibit"), "empty").otherwise("ok").alias("status"), F.sha1(F.col("hit_id").cast("binary")).alias("content_sha1"))
    return ds.with_sample(d.select("hit_id", "accession", "filename"), s, "hit_id").select("hit_id", "accession", "filename", "status", "content_sha1")


@query(
    "document_roles",
    f"""WITH {RECORDS}, r AS (SELECT *, CASE WHEN form IN ('SC TO-T', 'SC TO-T/A', 'SC TO-I', 'SC TO-I/A') AND (is_primary_form_doc OR NOT is_exhibit) THEN 'cover' WHEN form IN ('SC 14D9', 'SC 14D9/A') AND (is_primary_form_doc OR NOT is_exhibit) THEN 'sc_14d9'
      WHEN regexp_matches(file_description, '(?i)offer\\s+to\\s+purchase') OR regexp_matches(file_type, '(?i)ex-?99\\.?\\(?a\\)?\\.?\\(?1\\)?\\.?\\(?a\\)?') THEN 'otp'
      WHEN regexp_matches(file_description, '(?i)letter\\s+of\\s+transmittal') OR regexp_matches(file_type, '(?i)ex-?99\\.?\\(?a\\)?\\.?\\(?1\\)?\\.?\\(?b\\)?') THEN 'lot' END AS role FROM docs)
    SELECT hit_id, role, CASE WHEN role = 'otp' THEN CASE WHEN regexp_matches(file_description, '(?i)offer\\s+to\\s+purchase') THEN 'file_description' ELSE 'ex99_type' END
      WHEN role = 'lot' THEN CASE WHEN regexp_matches(file_description, '(?i)letter\\s+of\\s+transmittal') THEN 'file_description' ELSE 'ex99_type' END END AS role_method FROM r""",
)
def document_roles(spark, sf_dir):
    return pr.roles(documents(spark, sf_dir)).select("hit_id", "role", "role_method")


_ROLES = RECORDS + r""", r AS (SELECT *, CASE WHEN form IN ('SC TO-T', 'SC TO-T/A', 'SC TO-I', 'SC TO-I/A') AND (is_primary_form_doc OR NOT is_exhibit) THEN 'cover' WHEN form IN ('SC 14D9', 'SC 14D9/A') AND (is_primary_form_doc OR NOT is_exhibit) THEN 'sc_14d9'
  WHEN sequence = 2 THEN 'otp' WHEN sequence = 3 THEN 'lot' END AS role, file_description = 'Offer to Purchase' AS described FROM docs),
chosen AS (SELECT event_id, role, hit_id, described FROM r WHERE role IS NOT NULL QUALIFY row_number() OVER (PARTITION BY event_id, role ORDER BY CASE WHEN role = 'otp' AND NOT described THEN 1 ELSE 0 END,
  CASE WHEN role <> 'otp' THEN CAST(is_amendment AS INT) END NULLS FIRST, CASE WHEN role <> 'otp' THEN file_date END NULLS FIRST, accession, sequence, hit_id) = 1)"""


@query("priority_documents", f"WITH {_ROLES} SELECT event_id, role, hit_id FROM chosen")
def priority_documents(spark, sf_dir):
    return pr.priority_documents(documents(spark, sf_dir)).select("event_id", "role", "hit_id")


@query(
    "cohort_index",
    f"""WITH {_ROLES}, f AS (SELECT event_id, bool_or(role = 'cover') AS c, bool_or(role = 'otp') AS o, bool_or(role = 'sc_14d9') AS n FROM chosen GROUP BY event_id),
    e AS (SELECT event_id, coalesce(c, false) AS c, coalesce(o, false) AS o, coalesce(n, false) AS n FROM (SELECT DISTINCT event_id FROM docs) LEFT JOIN f USING (event_id))
    SELECT CASE WHEN c AND o AND n THEN 'gold' WHEN c AND n THEN 'needs_otp_resolve' ELSE 'incomplete' END AS cohort, count(*) AS n_events, count(*) FILTER (c AND o) AS n_download_ready, CAST(0 AS BIGINT) AS n_inferred FROM e GROUP BY ALL""",
)
def cohort_index(spark, sf_dir):
    return pr.cohort_index(pr.cohorts(documents(spark, sf_dir)))


@query("stratified_sample", f"WITH {RECORDS} SELECT form, hit_id FROM docs WHERE file_date IS NOT NULL QUALIFY row_number() OVER (PARTITION BY form ORDER BY is_primary_form_doc DESC, file_date, hit_id) <= 5")
def stratified_sample(spark, sf_dir):
    return sa.stratified(documents(spark, sf_dir).where("file_date is not null"), "form", 5, F.desc("is_primary_form_doc"), F.col("file_date"), F.col("hit_id")).select("form", "hit_id")


@query("sample_fallback", f"WITH {RECORDS}, k AS (SELECT hit_id, CASE WHEN form = 'DEFM14A' THEN 0 WHEN is_primary_form_doc AND form = 'SC TO-T/A' THEN 1 ELSE 2 END AS k FROM docs) SELECT hit_id FROM k WHERE k = (SELECT min(k) FROM k)")
def sample_fallback(spark, sf_dir):
    d = documents(spark, sf_dir).select("hit_id", "form", "is_primary_form_doc")
    return sa.with_fallback(d, F.col("form") == "DEFM14A", F.col("is_primary_form_doc") & (F.col("form") == "SC TO-T/A")).select("hit_id")


@query(
    "monthly_diverse_sample",
    f"""WITH {RECORDS}, m AS (SELECT CAST(date_trunc('month', file_date) AS DATE) AS month, primary_cik, file_date, hit_id FROM docs WHERE is_primary_form_doc AND file_date IS NOT NULL),
    t AS (SELECT *, row_number() OVER (PARTITION BY month, primary_cik ORDER BY file_date, hit_id) > 1 AS again FROM m) SELECT CAST(month AS VARCHAR) AS month, hit_id FROM t QUALIFY row_number() OVER (PARTITION BY month ORDER BY again, file_date, hit_id) <= 3""",
)
def monthly_diverse_sample(spark, sf_dir):
    d = documents(spark, sf_dir).where("is_primary_form_doc and file_date is not null").withColumn("month", F.trunc("file_date", "MM"))
    return sa.diverse_per_period(d, "month", "primary_cik", 3, F.col("file_date"), F.col("hit_id")).select(F.col("month").cast("string").alias("month"), "hit_id")


@query("year_diverse_sample")
def year_diverse_sample(spark, sf_dir):
    d = documents(spark, sf_dir).where("is_primary_form_doc and file_date is not null").select("hit_id", F.year("file_date").alias("year"), "entity_name", F.col("file_date").cast("string").alias("file_date"))
    return sa.diverse_by_year(d, 40, "year", "entity_name", ["file_date", "hit_id"])


@query(
    "choose_documents",
    """WITH h AS (SELECT CAST(l_orderkey AS VARCHAR) AS accession, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS document_id, CASE WHEN l_linenumber = 1 THEN 0 WHEN l_linestatus = 'F' THEN 1 END AS r, l_extendedprice AS score, CAST(date_trunc('month', o_orderdate) AS DATE) AS m FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    one AS (SELECT * FROM h WHERE r IS NOT NULL QUALIFY row_number() OVER (PARTITION BY accession ORDER BY r, score DESC, document_id) = 1) SELECT accession, document_id, score FROM one QUALIFY row_number() OVER (PARTITION BY m ORDER BY score DESC, accession) <= 4""",
)
def choose_documents(spark, sf_dir):
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    h = l.join(o, l.l_orderkey == o.o_orderkey).select(
        F.col("l_orderkey").cast("string").alias("accession"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("document_id"), F.lit("8-K").alias("form"),
        F.when(F.col("l_linenumber") == 1, "8-K").when(F.col("l_linestatus") == "F", "EX-99.1").otherwise("GRAPHIC").alias("file_type"), F.col("l_extendedprice").alias("score"), F.col("o_custkey").alias("cik"), F.col("o_orderdate").cast("date").alias("filing_date"),
    )
    return sa.choose_documents(h, 4).select("accession", "document_id", "score")
