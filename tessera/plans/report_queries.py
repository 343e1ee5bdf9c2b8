"""Summary tables on the star-schema tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as ev
from ..operators import reports as rp
from ..registry import query
from .corpus_queries import longs
from .surrogate import RECORDS, documents, table
from .text_queries import _EVIDENCE, _MENTIONS, _QUEUE, _screened, mentions

FORMS = ("html", "text", "pdf", "xml", "image", "other")


@query("form_crosstab", f"WITH {RECORDS} SELECT form, " + ", ".join(f"count(*) FILTER (format_guess = '{f}') AS \"{f}\"" for f in FORMS) + " FROM docs GROUP BY form")
def form_crosstab(spark, sf_dir):
    return rp.crosstab(documents(spark, sf_dir), "form", "format_guess", FORMS)


@query("folder_roles", f"WITH {RECORDS} SELECT form_family, format_guess, count(*) AS n, count(*) FILTER (is_primary_form_doc) AS n_ok, CAST(sum(sequence) AS BIGINT) AS total, count(DISTINCT accession) AS n_keys FROM docs GROUP BY ALL")
def folder_roles(spark, sf_dir):
    return rp.by_folder_and_role(documents(spark, sf_dir), "form_family", "format_guess", F.col("is_primary_form_doc"), "sequence", "accession")


@query(
    "metadata_inventory",
    f"WITH {RECORDS} SELECT form, count(*) AS n_rows, count(DISTINCT accession) AS n_filings, count(DISTINCT (accession, filename)) AS n_pairs, CAST(min(file_date) AS VARCHAR) AS first_date, CAST(max(file_date) AS VARCHAR) AS last_date, array_to_string(list_sort(list(DISTINCT doc_ext) FILTER (doc_ext IS NOT NULL)), ',') AS endings FROM docs GROUP BY form",
)
def metadata_inventory(spark, sf_dir):
    return longs(rp.metadata_inventory(documents(spark, sf_dir))).withColumn("endings", F.array_join("endings", ","))


@query("span_summary", f"WITH {_MENTIONS} SELECT field, count(*) AS n_spans, max(score) AS max_score FROM mentions GROUP BY field")
def span_summary(spark, sf_dir):
    return rp.span_summary(mentions(spark, sf_dir), "field")


@query("file_summary", f"WITH {_MENTIONS} SELECT accession, count(*) AS n_spans, array_to_string(list_sort(list(DISTINCT field)), ',') AS labels, max(score) AS max_score FROM mentions GROUP BY accession")
def file_summary(spark, sf_dir):
    return rp.file_summary(mentions(spark, sf_dir), "accession", "field").withColumn("labels", F.array_join("labels", ","))


@query("pattern_mentions", " UNION ALL ".join(f"SELECT doc_id, '{n}' AS pattern, CAST(len(regexp_extract_all(text, '{p}')) AS BIGINT) AS n, coalesce(regexp_matches(text, '{p}'), false) AS found FROM documents" for n, p in (("license", "[Ll]icen[sc]e"), ("year", "[0-9]{4}"))))
def pattern_mentions(spark, sf_dir):
    found = rp.mentions(table(spark, sf_dir, "documents"), "doc_id", "text", {"license": "[Ll]icen[sc]e", "year": "[0-9]{4}"})
    return found.select("doc_id", "pattern", "n", F.col("snippet").isNotNull().alias("found"))


@query("run_summary", "SELECT lang, count(*) AS n, list_sort(list(n_chars))[CAST(floor(count(*) / 2) AS INT) + 1] AS upper_median, median(n_chars) AS median FROM documents GROUP BY lang")
def run_summary(spark, sf_dir):
    return rp.run_summary(table(spark, sf_dir, "documents"), "lang", "n_chars").withColumn("upper_median", F.col("upper_median").cast("long"))


@query("artifact_funnel", "SELECT 'events' AS artifact, count(*) AS n_events FROM labels UNION ALL SELECT 'good', count(*) FILTER (quality = 1) FROM labels UNION ALL SELECT 'toxic', count(*) FILTER (toxic = 1) FROM labels")
def artifact_funnel(spark, sf_dir):
    return rp.artifact_funnel(table(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")), ["good", "toxic"])


@query(
    "fact_readiness",
    f"WITH {_MENTIONS}, b AS (SELECT accession, field, value FROM mentions QUALIFY row_number() OVER (PARTITION BY accession, field ORDER BY score DESC, pos) = 1), w AS (SELECT accession, "
    + ", ".join(f"coalesce(bool_or(field = '{f}' AND contains(value, 'Corporation')), false) AS {f}" for f in ("click", "view"))
    + " FROM b GROUP BY accession) SELECT 'click' AS field_hint, round(100 * avg(CAST(click AS INT)), 2) AS ready_pct FROM w UNION ALL SELECT 'view', round(100 * avg(CAST(view AS INT)), 2) FROM w",
)
def fact_readiness(spark, sf_dir):
    facts = mentions(spark, sf_dir).select("accession", F.col("field").alias("field_hint"), F.col("value").alias("raw"), F.col("score").alias("rank_score"), F.col("pos").alias("fact_id"))
    corporate = F.contains(F.col("raw"), F.lit("Corporation"))
    return rp.readiness(facts, "accession", ["click", "view"], {"click": corporate, "view": corporate})


@query(
    "date_recall",
    "WITH g AS (SELECT o_orderkey FROM orders WHERE year(o_orderdate) >= 2000), n AS (SELECT count(*) AS n_gold, count(*) FILTER (o_orderkey % 3 = 0) AS s, count(*) FILTER (o_orderkey % 3 <> 2) AS a FROM g) "
    "SELECT 'all' AS tier, a AS n_found, n_gold, round(a / n_gold, 6) AS recall FROM n UNION ALL SELECT 'strict', s, n_gold, round(s / n_gold, 6) FROM n UNION ALL SELECT 'broad', a - s, n_gold, round((a - s) / n_gold, 6) FROM n",
)
def date_recall(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 3
    gold = o.select("o_orderkey", F.date_format("o_orderdate", "MMMM d, yyyy").alias("gold"))
    said = o.where(k != 2).select("o_orderkey", F.when(k == 0, "strict").otherwise("broad").alias("tier"), F.date_format("o_orderdate", "M/d/yyyy").alias("value"))
    return rp.date_recall(gold, said, "o_orderkey")


@query("label_routing", "SELECT l_linestatus || l_returnflag AS k, CASE WHEN l_linestatus = 'F' THEN 'a|b' WHEN l_returnflag = 'R' THEN 'c' ELSE 'd|e|f' END AS labels, count(*) AS n FROM lineitem GROUP BY ALL")
def label_routing(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    labels = rp.routed_labels(F.when(F.col("l_linestatus") == "F", "faq").otherwise("toc_section"), F.when(F.col("l_returnflag") == "R", "cover").otherwise("otp"), ["a", "b"], ["c"], ["d", "e", "f"])
    return l.groupBy(F.concat("l_linestatus", "l_returnflag").alias("k"), F.array_join(labels, "|").alias("labels")).agg(F.count(F.lit(1)).alias("n"))


@query("presence_audit", f"WITH {_MENTIONS}, r AS (SELECT DISTINCT accession, field FROM mentions), c AS (SELECT DISTINCT accession, field FROM mentions WHERE score > 0.9) SELECT field, count(*) AS n_cells, count(c.accession) AS n_with_candidates FROM r LEFT JOIN c USING (accession, field) GROUP BY field")
def presence_audit(spark, sf_dir):
    m = mentions(spark, sf_dir)
    return rp.presence_audit(m.select("accession", "field").distinct(), m.where("score > 0.9"), ["accession", "field"])


@query("export_confirmed", f"WITH {_EVIDENCE}, {_QUEUE} SELECT queue.accession, suggested_priority FROM queue JOIN screened ON queue.accession = screened.accession WHERE queue.accession % 4 = 0")
def export_confirmed(spark, sf_dir):
    s, k = _screened(spark, sf_dir), F.col("accession") % 4
    q = ev.screen(s).join(s.select("accession", F.substring("text", 1, 4).alias("__q")), "accession").withColumn("review_label", F.lit("confirmed"))
    q = q.withColumn("text_sha256", F.when(k == 1, "old").otherwise(F.col("text_sha256"))).withColumn("confirmed_evidence", F.when(k == 2, "no such quote").otherwise(F.col("__q"))).withColumn("reviewed_at", F.when(k == 3, "soon").otherwise("2024-05-01"))
    return rp.confirmed(q, s, ev.stale_reviews(q, s)).select("accession", "suggested_priority")


@query(
    "deal_scoring",
    """WITH g AS (SELECT CAST(o_custkey AS VARCHAR) AS a, CAST(o_orderkey AS VARCHAR) AS r, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE CAST(o_orderkey AS VARCHAR) END AS d, CASE WHEN o_orderkey % 5 = 0 THEN 'absent' WHEN o_orderkey % 11 = 0 THEN 'unknown' ELSE 'present' END AS s,
      CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderpriority END AS v, CASE WHEN o_orderkey % 13 = 0 THEN 'open' ELSE 'verified' END AS w, CASE o_orderkey % 4 WHEN 0 THEN upper(o_orderpriority) WHEN 1 THEN 'wrong' WHEN 2 THEN '' END AS p FROM orders),
    o AS (SELECT *, CASE WHEN w <> 'verified' THEN 'not_reviewed' WHEN s = 'unknown' THEN 'unknown_gold' WHEN d = '' THEN 'missing_deal_id' WHEN p IS NULL AND n > 1 THEN 'multi_deal_unaligned' WHEN s = 'absent' AND coalesce(p, '') = '' THEN 'tn' WHEN s = 'absent' THEN 'fp' WHEN coalesce(p, '') = '' THEN 'fn' WHEN lower(p) = lower(v) THEN 'tp' ELSE 'mismatch' END AS outcome FROM g JOIN (SELECT a, count(DISTINCT r) AS n FROM g GROUP BY a) USING (a))
    SELECT outcome, count(*) AS n FROM o GROUP BY outcome""",
)
def deal_scoring(spark, sf_dir):
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    o = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("accession"), k.cast("string").alias("reference_row_id"), F.when(k % 7 == 0, "").otherwise(k.cast("string")).alias("deal_id"), F.lit("ticker").alias("field"),
        F.when(k % 5 == 0, "absent").when(k % 11 == 0, "unknown").otherwise("present").alias("gold_state"), F.when(k % 5 == 0, "").otherwise(p).alias("gold_value"), F.when(k % 13 == 0, "open").otherwise("verified").alias("review_status"),
        F.lit("").alias("comparison_override"), F.when(k % 4 == 0, F.upper(p)).when(k % 4 == 1, "wrong").when(k % 4 == 2, "").alias("predicted_value"),
    )
    predictions = o.where("predicted_value is not null and deal_id <> ''").select("accession", "deal_id", "field", "predicted_value")
    out = ev.deal_outcomes(o, predictions, ("ticker",), ("effective_date",), ("cash_consideration",))
    return out.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
