"""The field matrix over documents with notices' phrases and the events of the filing corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import EVENT_TYPES
from ..catalog_fields import FIELDS, INTERNAL, relevance
from ..operators import field_matrix as fm
from ..operators.report_run import REPORTS, run_reports
from ..registry import query
from ..sources import readers, sinks
from .surrogate import BASES, EVENTS, TAGGED, documents, events, table

PHRASES = (
    " The tender offer and the exchange offer expire; see CUSIP 123456789.", " Each voluntary tender of common stock; NYSE.", " The record date and the payment date follow.", " A conversion ratio per share of each share.", " The election deadline, if no election is made.",
    " Holders must elect to tender. USD.", " Principal amount of old notes due May 1, 2030.", " The offer price is $12.50 per share.", " Nothing.", " The offer has been terminated because of the price.", " Proration and a cash election.", " Redemption price, coupon, make-whole.",
)
_FORMS = list(BASES.values())
_SAMPLE = f"""sample AS (
  SELECT '005-' || lpad(CAST(doc_id % 1000 + 1 AS VARCHAR), 5, '0') AS event_id, {_FORMS}[doc_id % 7 + 1] AS form, doc_id % 10 <> 9 AS fetched,
    coalesce(text, '') || {list(PHRASES)}[coalesce(n_chars, 0) % {len(PHRASES)} + 1] AS text FROM documents
)"""
_MEASURED = [f for f in FIELDS if f.patterns]
_FLAGS = ", ".join("(" + " OR ".join(f"regexp_matches(text, '{p}')" for p in f.patterns) + f') AS "{f.name}"' for f in _MEASURED)
_PARTS = f"""{_SAMPLE}, found AS (SELECT event_id, form, {_FLAGS} FROM sample WHERE fetched),
long AS (UNPIVOT found ON {", ".join(f'"{f.name}"' for f in _MEASURED)} INTO NAME field VALUE has),
of_event AS (SELECT field, count(DISTINCT event_id) AS n_sample, count(DISTINCT event_id) FILTER (has) AS n_events FROM long GROUP BY field),
rates AS (SELECT field, form, count(*) AS n_docs, avg(CASE WHEN has THEN 1.0 ELSE 0.0 END) AS rate FROM long WHERE form IS NOT NULL GROUP BY ALL),
best AS (SELECT field, arg_min(form, (-rate, form)) AS best_form FROM rates GROUP BY field)"""
_FIXED = ", ".join(f"('{f.name}', '{f.group}', '{f.source_class}', '{f.kind}', '{f.difficulty}', '{f.ground_truth}', {bool(f.patterns)})" for f in FIELDS)


def _sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, at = table(spark, sf_dir, "documents"), lambda values, k: F.get(F.array(*map(F.lit, values)), k)
    number = F.lpad((F.col("doc_id") % 1000 + 1).cast("string"), 5, "0")
    return d.select(
        F.concat(F.lit("005-"), number).alias("event_id"), at(_FORMS, (F.col("doc_id") % 7).cast("int")).alias("form"), F.when(F.col("doc_id") % 10 == 9, "failed").otherwise("ok").alias("status"),
        F.col("doc_id").cast("string").alias("accession"), (F.col("doc_id") % 3 == 1).alias("is_amendment"),
        F.concat(F.coalesce("text", F.lit("")), at(PHRASES, (F.coalesce("n_chars", F.lit(0)) % len(PHRASES)).cast("int"))).alias("text"),
    )


@query(
    "field_matrix",
    "WITH " + EVENTS + f""", {_PARTS}, fields(field, "group", source_class, explicit_or_derived, difficulty, ground_truth_class, measured) AS (VALUES {_FIXED}),
    known AS (SELECT count(*) AS n_all, count(*) FILTER (len(tickers) > 0) AS n_ticker, count(*) FILTER (primary_entity <> '') AS n_security_description FROM evs),
    rule AS (SELECT *, CASE WHEN source_class = '{INTERNAL}' THEN 1 WHEN field = 'corporate_action_type' THEN 2 WHEN field IN ('ticker', 'security_description') THEN 3 WHEN NOT measured THEN 4 WHEN coalesce(n_sample, 0) = 0 THEN 5 ELSE 6 END AS r,
      CASE field WHEN 'ticker' THEN n_ticker ELSE n_security_description END AS n_meta FROM fields CROSS JOIN known LEFT JOIN of_event USING (field) LEFT JOIN best USING (field)),
    cover AS (SELECT *, CASE r WHEN 1 THEN 0.0 WHEN 2 THEN 100.0 WHEN 3 THEN round(100.0 * n_meta / n_all, 2) WHEN 4 THEN 0.0 WHEN 6 THEN round(100.0 * n_events / n_sample, 2) END AS c FROM rule)
    SELECT field, "group", CAST(c AS DOUBLE) AS public_coverage_pct, CAST(round(100 - c, 2) AS DOUBLE) AS missing_pct, CAST(CASE r WHEN 2 THEN n_all WHEN 3 THEN n_meta WHEN 6 THEN n_events ELSE 0 END AS BIGINT) AS n_detected_events,
      CAST(CASE WHEN r <= 3 THEN n_all WHEN r IN (4, 6) THEN coalesce(n_sample, (SELECT max(n_sample) FROM of_event)) ELSE 0 END AS BIGINT) AS n_events_denominator,
      CASE WHEN r = 1 THEN 'all_events_definitional_zero' WHEN r = 2 OR field = 'security_description' THEN 'all_events_metadata' WHEN r = 3 THEN 'all_events_metadata; sample_text_detection_pct=' || printf('%.1f', 100.0 * n_events / n_sample)
        WHEN r = 4 THEN 'no_public_patterns_or_internal' WHEN r = 5 THEN 'no_successful_text_sample' ELSE 'sample_events_with_downloaded_text' END AS denominator_note,
      CASE r WHEN 1 THEN 'internal client' WHEN 2 THEN 'EFTS form family' WHEN 3 THEN CASE field WHEN 'ticker' THEN 'EFTS display_names (metadata)' ELSE 'EFTS entity_name / filing text' END WHEN 4 THEN 'not measured' WHEN 5 THEN 'insufficient sample' ELSE best_form END AS primary_source,
      CASE r WHEN 1 THEN 'internal_only' WHEN 2 THEN 'observed_metadata' WHEN 3 THEN 'observed_metadata' WHEN 6 THEN 'inferred_regex_presence' ELSE 'not_measured' END AS evidence_type, explicit_or_derived, difficulty, source_class, ground_truth_class FROM cover""",
)
def field_matrix(spark, sf_dir):
    return fm.field_matrix(events(spark, sf_dir), fm.scans(_sample(spark, sf_dir)))


_RELEVANCE = ", ".join(f"('{t}', '{f.name}', '{relevance(t, f.name)}')" for t in EVENT_TYPES for f in FIELDS)


@query(
    "event_type_matrix",
    "WITH " + EVENTS + f""", {_PARTS}, fields(field, "group", source_class, explicit_or_derived, difficulty, ground_truth_class, measured) AS (VALUES {_FIXED}), rel(corporate_action_type, field, relevance_assumption) AS (VALUES {_RELEVANCE}),
    typed AS (SELECT DISTINCT event_id, coalesce(primary_form_family, 'unknown') AS corporate_action_type FROM found LEFT JOIN evs USING (event_id)),
    sizes AS (SELECT corporate_action_type, count(*) AS n_sample_events FROM typed GROUP BY 1),
    hits AS (SELECT corporate_action_type, field, count(DISTINCT event_id) FILTER (has) AS n FROM long JOIN typed USING (event_id) GROUP BY ALL)
    SELECT corporate_action_type, field, CAST(CASE WHEN source_class = '{INTERNAL}' THEN 0.0 WHEN field = 'corporate_action_type' THEN 100.0 ELSE round(100.0 * n / n_sample_events, 2) END AS DOUBLE) AS coverage_pct, n_sample_events,
      CASE WHEN source_class = '{INTERNAL}' THEN 'internal_only' WHEN field = 'corporate_action_type' THEN 'observed_metadata' WHEN n IS NOT NULL THEN 'inferred_regex_presence' ELSE 'not_measured' END AS evidence_type, coalesce(relevance_assumption, 'relevant') AS relevance_assumption
    FROM sizes CROSS JOIN fields LEFT JOIN hits USING (corporate_action_type, field) LEFT JOIN rel USING (corporate_action_type, field)""",
)
def event_type_matrix(spark, sf_dir):
    return fm.event_type_matrix(events(spark, sf_dir), fm.scans(_sample(spark, sf_dir)))


@query("source_preference", f"WITH {_PARTS} SELECT field, form, CAST(round(100 * rate, 2) AS DOUBLE) AS doc_detection_rate_pct, n_docs FROM rates")
def source_preference(spark, sf_dir):
    return fm.source_preference(fm.scans(_sample(spark, sf_dir)))


_COUNTS = {
    "n_documents": "(SELECT count(*) FROM docs)", "first_file_date": "(SELECT CAST(min(file_date) AS VARCHAR) FROM docs)", "last_file_date": "(SELECT CAST(max(file_date) AS VARCHAR) FROM docs)",
    "n_events": "(SELECT count(*) FROM tagged)", "mvp_event_count": "(SELECT count(*) FROM tagged WHERE in_core)", "mvp_preferred_count": "(SELECT count(*) FROM tagged WHERE in_preferred)",
    "mvp_with_14d9_count": "(SELECT count(*) FROM tagged WHERE in_core AND has_14d9)", "issuer_stretch_event_count": "(SELECT count(*) FROM tagged WHERE in_stretch)", "amendment_eval_simple_count": "(SELECT count(*) FROM tagged WHERE amendment_band = 'simple')",
    "amendment_eval_complex_count": "(SELECT count(*) FROM tagged WHERE amendment_band = 'complex')", "notification_eval_count": "(SELECT count(*) FROM tagged WHERE in_core AND n_primary_docs >= 1)",
    **{f"approx_{k}_events": f"(SELECT CAST(round_even({v} * count(*), 0) AS BIGINT) FROM tagged WHERE in_core)" for k, v in (("train", 0.70), ("validation", 0.15), ("test", 0.15))},
    "n_text_events": "(SELECT count(DISTINCT event_id) FROM sample WHERE fetched)", "n_reports": "18",
}
_ROWS = {
    "schema_coverage": len(FIELDS), "event_type_coverage": f"(SELECT {len(FIELDS)} * count(DISTINCT coalesce(primary_form_family, 'unknown')) FROM sample LEFT JOIN tagged USING (event_id) WHERE fetched)", "mvp_event_taxonomy": 5, "mvp_corpus_gaps": 5, "mvp_build_order": 5,
    "datastore_field_catalog": len(FIELDS), "mvp_events": _COUNTS["mvp_event_count"], "mvp_selection_funnel": 6, "dataset_overview": 8, "form_counts": "(SELECT count(DISTINCT coalesce(form, '')) FROM docs)", "events": _COUNTS["n_events"], "ground_truth_feasibility": len(FIELDS),
    "unusual_document_volume": f"least(15, {_COUNTS['n_events']})", "unusual_amendment_volume": f"least(15, {_COUNTS['n_events']})", "simple_amendment_examples": "(SELECT least(10, count(*)) FROM tagged WHERE n_amendment_filings = 1)", "complex_amendment_examples": "(SELECT least(10, count(*)) FROM tagged WHERE has_amendment)",
}


@query("report_run", f"WITH {TAGGED}, {_SAMPLE} " + " UNION ALL ".join([*[f"SELECT '{k}' AS metric, CAST({v} AS VARCHAR) AS value" for k, v in _COUNTS.items()], *[f"SELECT 'rows of {k}', CAST({v} AS VARCHAR)" for k, v in _ROWS.items()]]))
def report_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reports of the filing corpus, written and read back: the run's summary and the reports' rows."""
    root = sinks.work_folder(spark, "reports")
    out = run_reports(spark, documents(spark, sf_dir), _sample(spark, sf_dir), root)
    for name in REPORTS:
        if name in _ROWS:
            rows = readers.read_csv(spark, f"{root}/{name}").agg(F.count(F.lit(1)).cast("string").alias("value"))
            out = out.unionByName(rows.select(F.lit(f"rows of {name}").alias("metric"), "value"))
    return out
