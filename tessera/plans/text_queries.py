"""Coverage, text, span and evaluation queries, on the document, page and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..catalog import AGENTS, EVENT_TYPES, SHELLS
from ..catalog_fields import AUTOMATIC, BENCHMARK_FIELDS, INTERNAL, MANUAL, NEVER, UNCLEAR, WEAK, relevance
from ..operators import amendments as am
from ..operators import coverage as cv
from ..operators import evaluation as ev
from ..operators import markup as mk
from ..operators import mvp
from ..operators import spans as sp
from ..operators import stages as st
from ..registry import query
from ..sources.readers import month_windows
from .surrogate import RECORDS, TAGGED, documents, events, table

#: Pattern families that the invented prose can match, in a form that both regex dialects read alike.
PATTERNS = {"the": ("(?i)\\bthe\\b", "(?i)\\bder\\b"), "license": ("(?i)licen[sc]e",), "digits": ("[0-9]{4}", "[0-9]-[0-9]"), "shout": ("!!",), "bars": ("\\|",)}
FIELDS = list(PATTERNS)
LANGS = ["de", "en", "es", "fr"]


def _duck(patterns: tuple[str, ...]) -> str:
    return " OR ".join(f"regexp_matches(text, '{p}')" for p in patterns)


_FLAGS = "flags AS (SELECT doc_id, lang, source, " + ", ".join(f"({_duck(p)}) AS {n}" for n, p in PATTERNS.items()) + " FROM documents)"
_BY_LANG = " UNION ALL ".join(f"SELECT lang, '{n}' AS field, count(*) AS n_rows, count(*) FILTER ({n}) AS n_detected FROM flags GROUP BY lang" for n in FIELDS)


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cv.flagged(table(spark, sf_dir, "documents"), PATTERNS, "text", ["doc_id", "lang", "source"])


@query("field_flags", f"WITH {_FLAGS} SELECT doc_id, {', '.join(FIELDS)} FROM flags")
def field_flags(spark, sf_dir):
    return flags(spark, sf_dir).drop("lang", "source")


@query("field_hit_counts", " UNION ALL ".join(f"SELECT doc_id, '{n}' AS field, CAST({' + '.join(f'CAST(regexp_matches(text, {chr(39)}{x}{chr(39)}) AS BIGINT)' for x in p)} AS BIGINT) AS n_pattern_hits FROM documents" for n, p in PATTERNS.items()))
def field_hit_counts(spark, sf_dir):
    return cv.hit_counts(table(spark, sf_dir, "documents"), PATTERNS, "text", "doc_id")


@query("field_coverage", f"WITH {_FLAGS}, r AS (" + " UNION ALL ".join(f"SELECT count(*) AS n_rows, '{n}' AS field, count(*) FILTER ({n}) AS n_detected FROM flags" for n in FIELDS) + ") SELECT *, round(100 * n_detected / n_rows, 2) AS coverage_pct FROM r")
def field_coverage(spark, sf_dir):
    return cv.by_field(flags(spark, sf_dir), FIELDS)


@query("field_coverage_by_lang", f"WITH {_FLAGS}, r AS ({_BY_LANG}) SELECT *, round(100 * n_detected / n_rows, 2) AS coverage_pct FROM r")
def field_coverage_by_lang(spark, sf_dir):
    return cv.by_group(flags(spark, sf_dir), FIELDS, "lang")


@query("group_flags", f"WITH {_FLAGS} SELECT source, " + ", ".join(f"bool_or({n}) AS {n}" for n in FIELDS) + " FROM flags GROUP BY source")
def group_flags(spark, sf_dir):
    return cv.any_of_group(flags(spark, sf_dir), FIELDS, "source")


@query("best_source", f"WITH {_FLAGS}, r AS ({_BY_LANG}), c AS (SELECT *, round(100 * n_detected / n_rows, 2) AS coverage_pct FROM r) SELECT field, lang AS best_source, coverage_pct FROM c QUALIFY row_number() OVER (PARTITION BY field ORDER BY coverage_pct DESC, lang) = 1")
def best_source(spark, sf_dir):
    return cv.best_source(cv.by_group(flags(spark, sf_dir), FIELDS, "lang"), "lang")


@query("coverage_pivot", f"WITH {_FLAGS}, r AS ({_BY_LANG}), c AS (SELECT field, lang, round(100 * n_detected / n_rows, 2) AS p FROM r) SELECT field, " + ", ".join(f"max(p) FILTER (lang = '{x}') AS {x}" for x in LANGS) + " FROM c GROUP BY field")
def coverage_pivot(spark, sf_dir):
    return cv.pivoted(cv.by_group(flags(spark, sf_dir), FIELDS, "lang"), "lang", LANGS)


_MATRIX = mvp.FIELDS


def _values(rows: list[tuple]) -> str:
    shown = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + str(v).replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(shown, r)) + ")" for r in rows)


def _field_sql() -> str:
    """fields, rel and cov: the catalog as it is, and how many documents mention each field."""
    matched = lambda f: " OR ".join("regexp_matches(text, '(?i)" + p.removeprefix("(?i)").replace("'", "''") + "')" for p in f.patterns)
    counts = ", ".join(f"count(*) FILTER ({matched(f)}) AS {f.name}" for f in _MATRIX if f.patterns)
    cov = " UNION ALL ".join(f"SELECT '{f.name}' AS field, round(100 * {f.name} / n, 2) AS coverage_pct FROM counted" for f in _MATRIX if f.patterns)
    fields = _values([(f.name, f.group, f.source_class, f.kind, f.ground_truth, f.name in BENCHMARK_FIELDS) for f in _MATRIX])
    rel = _values([(t, f.name, relevance(t, f.name)) for t in EVENT_TYPES for f in _MATRIX])
    return f"""fields(field, field_group, source_class, kind, truth, in_benchmark) AS (VALUES {fields}), rel(event_type, field, relevance) AS (VALUES {rel}),
    counted AS (SELECT count(*) AS n, {counts} FROM documents), cov AS ({cov})"""


@query(
    "field_catalog",
    f"""WITH {_field_sql()}, types AS (SELECT field, string_agg(event_type, ',' ORDER BY event_type) AS relevant_types FROM rel WHERE relevance <> 'not_relevant' GROUP BY field)
    SELECT field, field_group, CASE WHEN source_class = '{INTERNAL}' THEN 'placeholder' WHEN source_class = '{UNCLEAR}' THEN 'exclude_or_investigate' WHEN truth IN ('{AUTOMATIC}', '{WEAK}') THEN CASE WHEN kind = 'derived' THEN 'derive_from_public' ELSE 'extract_from_public' END
      WHEN truth = '{MANUAL}' THEN 'annotate_then_store' ELSE 'exclude_or_investigate' END AS role,
      CASE WHEN source_class = '{INTERNAL}' THEN 'placeholder_only' WHEN source_class = '{UNCLEAR}' THEN 'no_client_amount_without_position' WHEN truth = '{AUTOMATIC}' THEN 'yes_metadata' WHEN truth = '{WEAK}' THEN 'yes_with_caveat' WHEN truth = '{MANUAL}' THEN 'after_annotation' ELSE 'no' END AS notification_ready,
      in_benchmark, coalesce(relevant_types, '') AS relevant_types, coverage_pct FROM fields LEFT JOIN types USING (field) LEFT JOIN cov USING (field)""",
)
def field_catalog(spark, sf_dir):
    return mvp.field_catalog(spark, _field_coverage(spark, sf_dir))


@query(
    "missingness",
    f"""WITH {_field_sql()}, r AS (SELECT field, bool_and(relevance = 'not_relevant') AS never, bool_or(relevance = 'optional') AS sometimes FROM rel GROUP BY field)
    SELECT field, field_group, coverage_pct, CASE WHEN source_class = '{INTERNAL}' THEN 'internal_only' WHEN coverage_pct IS NULL THEN 'parsing_or_sample_gap' WHEN source_class = '{UNCLEAR}' THEN 'unclear_or_partially_public' WHEN coverage_pct >= 80 THEN 'usually_present_in_public_sample'
      WHEN coverage_pct >= 20 THEN 'sometimes_present_in_public_sample' WHEN never THEN 'not_relevant_for_observed_event_types' WHEN sometimes THEN 'optional_for_many_events_or_absent' ELSE 'likely_relevant_but_rarely_detected' END AS missingness FROM fields JOIN r USING (field) LEFT JOIN cov USING (field)""",
)
def missingness(spark, sf_dir):
    return mvp.missingness(spark, _field_coverage(spark, sf_dir))


@query(
    "benchmark_recommendation",
    f"""WITH {_field_sql()} SELECT field, field_group, coverage_pct, CASE WHEN truth = '{AUTOMATIC}' THEN 'include_in_benchmark' WHEN truth = '{NEVER}' THEN 'exclude_from_public_benchmark' WHEN truth = '{WEAK}' AND coalesce(coverage_pct, -1) >= 50 THEN 'include_as_weak_proxy_only'
      WHEN truth = '{MANUAL}' AND coalesce(coverage_pct, -1) >= 40 THEN 'prioritize_for_manual_annotation' WHEN truth = '{MANUAL}' THEN 'annotate_later_or_event_type_specific' ELSE 'investigate' END AS recommendation FROM fields LEFT JOIN cov USING (field)""",
)
def benchmark_recommendation(spark, sf_dir):
    return mvp.benchmark_recommendation(spark, _field_coverage(spark, sf_dir))


def _field_coverage(spark, sf_dir):
    """How many documents mention each of the 39 fields, by the shipped patterns."""
    patterns = {f.name: f.patterns for f in _MATRIX if f.patterns}
    found = cv.by_field(cv.flagged(table(spark, sf_dir, "documents"), patterns, "text", ["doc_id"]), list(patterns))
    return found.select("field", "coverage_pct")


@query("schema_coverage_matrix", f"WITH {_field_sql()} SELECT field, field_group, source_class, CASE WHEN source_class = 'internal_only' THEN 0.0 ELSE coverage_pct END AS coverage_pct FROM fields LEFT JOIN cov USING (field)")
def schema_coverage_matrix(spark, sf_dir):
    return mvp.field_table(spark).join(F.broadcast(_field_coverage(spark, sf_dir)), "field", "left").select("field", "field_group", "source_class", F.when(F.col("source_class") == "internal_only", 0.0).otherwise(F.col("coverage_pct")).alias("coverage_pct"))


_DELTA = f"""WITH {RECORDS}, f AS (SELECT event_id, accession, is_amendment, bool_or(file_description = 'Offer to Purchase') AS offer, bool_or(doc_ext = '.pdf') AS pdf, bool_or(entity_name IS NULL) AS unnamed FROM docs GROUP BY ALL),
b AS (SELECT * FROM f WHERE NOT is_amendment QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY accession) = 1),
d AS (SELECT f.event_id, b.accession AS initial_accession, f.accession AS amendment_accession, array_to_string(list_filter([CASE WHEN f.offer <> b.offer THEN 'offer' END, CASE WHEN f.pdf <> b.pdf THEN 'pdf' END, CASE WHEN f.unnamed <> b.unnamed THEN 'unnamed' END], lambda x: x IS NOT NULL), ',') AS fields_changed FROM f JOIN b USING (event_id) WHERE f.is_amendment)"""


def _deltas(spark, sf_dir):
    d = documents(spark, sf_dir)
    f = d.groupBy("event_id", "accession", "is_amendment").agg(F.bool_or(F.col("file_description") == "Offer to Purchase").alias("offer"), F.bool_or(F.coalesce(F.col("doc_ext") == ".pdf", F.lit(False))).alias("pdf"), F.bool_or(F.col("entity_name").isNull()).alias("unnamed"))
    return am.presence_deltas(f, ["offer", "pdf", "unnamed"])


@query("amendment_field_deltas", _DELTA.replace("doc_ext = '.pdf'", "coalesce(doc_ext = '.pdf', false)") + " SELECT * FROM d")
def amendment_field_deltas(spark, sf_dir):
    return _deltas(spark, sf_dir).select("event_id", "initial_accession", "amendment_accession", F.array_join("fields_changed", ",").alias("fields_changed"))


@query("amendment_delta_summary", _DELTA.replace("doc_ext = '.pdf'", "coalesce(doc_ext = '.pdf', false)") + " SELECT field, count(*) AS n_pairs FROM (SELECT unnest(string_split(fields_changed, ',')) AS field FROM d WHERE fields_changed <> '') GROUP BY field")
def amendment_delta_summary(spark, sf_dir):
    return am.delta_summary(_deltas(spark, sf_dir))


# Candidate mentions: events of a user are a filing's spans, their type the field, their key the value.
_VALUE = "'Name ' || CAST(json_extract(props, '$.k') AS INT) % 7 || CASE WHEN event_id % 5 = 0 THEN ' Corporation' WHEN event_id % 11 = 0 THEN ' $' || event_id || ' MILLION' WHEN event_id % 13 = 0 THEN ' $' || event_id ELSE '' END"
_MENTIONS = f"mentions AS (SELECT CAST(user_id AS VARCHAR) AS accession, event_type AS field, {_VALUE} AS value, round(value / 100, 6) AS score, event_id AS pos FROM events)"


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int") % 7
    ending = F.when(F.col("event_id") % 5 == 0, " Corporation").when(F.col("event_id") % 11 == 0, F.concat(F.lit(" $"), F.col("event_id").cast("string"), F.lit(" MILLION"))).when(F.col("event_id") % 13 == 0, F.concat(F.lit(" $"), F.col("event_id").cast("string"))).otherwise("")
    return e.select(F.col("user_id").cast("string").alias("accession"), F.col("event_type").alias("field"), F.concat(F.lit("Name "), k.cast("string"), ending).alias("value"), F.round(F.col("value") / 100, 6).alias("score"), F.col("event_id").alias("pos"))


@query("top1_per_field", f"WITH {_MENTIONS} SELECT accession, field, value, score, pos FROM mentions QUALIFY row_number() OVER (PARTITION BY accession, field ORDER BY score DESC, pos) = 1")
def top1_per_field(spark, sf_dir):
    return sp.top1(mentions(spark, sf_dir), ["accession", "field"])


def _consensus_sql(bonus: float, full: float, vague: float, threshold: float = 0.05) -> str:
    return f"""WITH {_MENTIONS}, e AS (SELECT *, lower(value) AS key FROM mentions WHERE score >= {threshold}), v AS (
      SELECT accession, field, key, max(score) AS best, count(*) AS n_mentions, min(pos) AS first, arg_min(value, pos) AS name, arg_max({{'value': value, 'score': score, 'pos': pos}}, (score, -pos)) AS m FROM e GROUP BY ALL),
      t AS (SELECT *, round(best + {bonus} * ln(1 + n_mentions) + CASE WHEN regexp_matches(name, '(?i)\\bcorporation\\b') AND length(name) > 10 THEN {full} ELSE 0 END - CASE WHEN length(name) < 8 THEN {vague} ELSE 0 END, 9) AS total FROM v)
      SELECT accession, field, m.value AS value, m.score AS score, m.pos AS pos, n_mentions FROM t QUALIFY row_number() OVER (PARTITION BY accession, field ORDER BY total DESC, first) = 1"""


@query("consensus_rerank", _consensus_sql(0.07, 0, 0))
def consensus_rerank(spark, sf_dir):
    return sp.consensus(mentions(spark, sf_dir), ["accession", "field"], threshold=0.05)


@query("role_aware_rerank", _consensus_sql(0.12, 0.08, 0.16))
def role_aware_rerank(spark, sf_dir):
    return sp.consensus(mentions(spark, sf_dir), ["accession", "field"], 0.12, 0.05, full_name=0.08, generic=0.16)


@query("cash_abstain", f"WITH {_MENTIONS} SELECT accession, value, score, pos FROM mentions WHERE regexp_matches(value, '\\$\\s*\\d') AND NOT regexp_matches(value, '(?i)\\b(?:million|billion)\\b') QUALIFY row_number() OVER (PARTITION BY accession ORDER BY score DESC, pos) = 1")
def cash_abstain(spark, sf_dir):
    m = mentions(spark, sf_dir).where(F.col("value").rlike(r"\$\s*\d") & ~F.col("value").rlike(r"(?i)\b(?:million|billion)\b"))
    return sp.top1(m, ["accession"])


_NAMED = _MENTIONS + ", named AS (SELECT accession, CASE field WHEN 'click' THEN 'acquirer' WHEN 'view' THEN 'target' WHEN 'purchase' THEN 'cash_consideration' ELSE field END AS field, value, score, pos FROM mentions)"


@query(
    "assembled_fields",
    f"""WITH {_NAMED}, e AS (SELECT *, lower(value) AS key FROM named WHERE score >= 0.4 AND field IN ('acquirer', 'target')),
    v AS (SELECT accession, field, key, max(score) AS best, count(*) AS n, min(pos) AS first, arg_min(value, pos) AS name, arg_max({{'value': value, 'score': score, 'pos': pos}}, (score, -pos)) AS m FROM e GROUP BY ALL),
    c AS (SELECT *, round(best + 0.12 * ln(1 + n) + CASE WHEN regexp_matches(name, '(?i)\\bcorporation\\b') AND length(name) > 10 THEN 0.08 ELSE 0 END - CASE WHEN length(name) < 8 THEN 0.16 ELSE 0 END, 9) AS total FROM v),
    parties AS (SELECT accession, field, m.value AS value, m.score AS score, m.pos AS pos FROM c QUALIFY row_number() OVER (PARTITION BY accession, field ORDER BY total DESC, first) = 1),
    others AS (SELECT * FROM named WHERE score >= 0.4 AND field NOT IN ('acquirer', 'target') AND (field <> 'cash_consideration' OR (regexp_matches(value, '\\$\\s*[0-9]') AND NOT regexp_matches(value, '(?i)\\b(million|billion)\\b'))) QUALIFY row_number() OVER (PARTITION BY accession, field ORDER BY score DESC, pos) = 1)
    SELECT * FROM parties UNION ALL SELECT * FROM others""",
)
def assembled_fields(spark, sf_dir):
    names = F.create_map(*[F.lit(x) for x in ("click", "acquirer", "view", "target", "purchase", "cash_consideration")])
    m = mentions(spark, sf_dir).withColumn("field", F.coalesce(names[F.col("field")], F.col("field"))).withColumn("source_quote", F.col("value"))
    return sp.assembled(m, ["accession", "field"])


@query(
    "rank_dedupe_topk",
    f"""WITH {_MENTIONS}, r AS (SELECT *, score + CASE WHEN regexp_matches(value, '(?i)\\$\\s*[\\d,]+(?:\\.\\d+)?') THEN 0.45 ELSE 0 END AS rank_score FROM mentions),
    one AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY accession, field, lower(value) ORDER BY rank_score DESC, pos) = 1)
    SELECT accession AS event_id, pos AS span_id, round(rank_score, 6) AS rank_score FROM one QUALIFY row_number() OVER (PARTITION BY accession, field ORDER BY rank_score DESC, pos) <= 12""",
)
def rank_dedupe_topk(spark, sf_dir):
    m = mentions(spark, sf_dir).select(F.col("accession").alias("event_id"), F.col("pos").alias("span_id"), F.col("field").alias("group"), F.col("value").alias("text"), F.lit("cash_amount").alias("label"), "score", F.lit("").alias("doc_role"), F.lit("").alias("segment_kind"), F.lit(False).alias("priority"))
    ranked = sp.ranked(m).withColumn("field_hint", F.col("group"))
    return sp.best_spans(ranked).select("event_id", "span_id", F.round("rank_score", 6).alias("rank_score"))


@query(
    "proximity_join",
    """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS accession, event_id, event_type, CAST(floor(value * 100) AS BIGINT) AS start, CAST(json_extract(props, '$.k') AS VARCHAR) AS value FROM events),
    p AS (SELECT d.accession, d.event_id AS date_id, x.value AS party, min(abs(d.start - x.start)) AS distance FROM e d JOIN e x ON d.accession = x.accession AND abs(d.start - x.start) <= 900 WHERE d.event_type = 'click' AND x.event_type = 'view' GROUP BY ALL)
    SELECT accession, date_id, party, distance FROM p QUALIFY row_number() OVER (PARTITION BY accession, date_id ORDER BY distance, party) <= 3""",
)
def proximity_join(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("accession"), "event_id", "event_type", F.floor(F.col("value") * 100).cast("long").alias("start"), F.get_json_object("props", "$.k").alias("value"))
    dates = e.where("event_type = 'click'").select("accession", F.col("event_id").alias("date_id"), "start")
    return sp.near_parties(dates, e.where("event_type = 'view'").select("accession", "value", "start")).select("accession", "date_id", "party", "distance")


def _candidates(field: str, n: int) -> str:
    first = f"SELECT accession, window_id, value, min(r) AS r FROM ranked WHERE field = '{field}' AND r <= {n} GROUP BY ALL"
    return f"(SELECT string_agg(value, ' | ' ORDER BY r) FROM ({first}) c WHERE c.accession = w.accession AND c.window_id = w.window_id)"


@query(
    "review_clusters",
    f"""WITH {_NAMED}, ranked AS (SELECT *, pos % 4 AS window_id, row_number() OVER (PARTITION BY accession, pos % 4, field ORDER BY score DESC, pos) AS r FROM named),
    w AS (SELECT accession, window_id, arg_max(value, (score, -pos)) AS source_quote FROM ranked GROUP BY ALL)
    SELECT accession, window_id, '' AS deal_id, '' AS review_status, coalesce({_candidates("acquirer", 4)}, '') AS acquirer_candidates, coalesce({_candidates("target", 4)}, '') AS target_candidates, coalesce({_candidates("cash_consideration", 3)}, '') AS cash_candidates, source_quote FROM w""",
)
def review_clusters(spark, sf_dir):
    names = F.create_map(*[F.lit(x) for x in ("click", "acquirer", "view", "target", "purchase", "cash_consideration")])
    m = mentions(spark, sf_dir).withColumn("field", F.coalesce(names[F.col("field")], F.col("field"))).withColumn("window_id", F.col("pos") % 4).withColumn("source_quote", F.col("value"))
    return sp.review_clusters(m)


# Evaluation: a rule's verdict against the labels.
_LABELLED = "cells AS (SELECT l.doc_id, f.field, f.gold, f.predicted FROM labels l JOIN documents d USING (doc_id), LATERAL (VALUES ('quality', l.quality = 1, NOT regexp_matches(d.text, '!!|[|]')), ('toxic', l.toxic = 1, regexp_matches(d.text, '(?i)trash|idiot|scum'))) f(field, gold, predicted)), o AS (SELECT *, CASE WHEN gold AND predicted THEN 'tp' WHEN predicted THEN 'fp' WHEN gold THEN 'fn' ELSE 'tn' END AS outcome FROM cells)"
_PRF = "CAST(count(*) FILTER (outcome = 'tp') AS BIGINT) AS tp, count(*) FILTER (outcome = 'fp') AS fp, count(*) FILTER (outcome = 'fn') AS fn, count(*) FILTER (outcome = 'tn') AS tn, count(*) AS scored"
_RATES = "round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round((tp + tn) / scored, 6) AS accuracy"


#: Rules for the two fields: text that isn't good, text that is toxic.
BASELINE_RULES, ENHANCED_RULES = ("!!|[|]", "(?i)trash|idiot|scum"), ("!!|[|]|[0-9]-[0-9]", "(?i)trash|idiot|scum|vermin|worthless")


def outcomes(spark, sf_dir, rules=BASELINE_RULES):
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    cell = lambda n, g, p: F.struct(F.lit(n).alias("field"), g.alias("gold"), p.alias("predicted"))
    cells = j.select("doc_id", F.explode(F.array(cell("quality", F.col("quality") == 1, ~F.col("text").rlike(rules[0])), cell("toxic", F.col("toxic") == 1, F.col("text").rlike(rules[1])))).alias("c")).select("doc_id", "c.*")
    return cells.withColumn("outcome", F.when(F.col("gold") & F.col("predicted"), "tp").when(F.col("predicted"), "fp").when(F.col("gold"), "fn").otherwise("tn"))


@query("prf_by_field", f"WITH {_LABELLED}, s AS (SELECT coalesce(field, '(all)') AS field, {_PRF} FROM o GROUP BY GROUPING SETS ((field), ())) SELECT *, {_RATES} FROM s")
def prf_by_field(spark, sf_dir):
    return ev.summed(outcomes(spark, sf_dir), [])


_COHORTS = (
    f"WITH {_LABELLED}, c AS (SELECT o.*, unnest(['all', CASE WHEN ascii(right(sha256(CAST(doc_id AS VARCHAR)), 1)) % 2 = CASE WHEN right(sha256(CAST(doc_id AS VARCHAR)), 1) BETWEEN 'a' AND 'f' THEN 1 ELSE 0 END THEN 'development' ELSE 'comparison' END]) AS cohort FROM o), "
    f"s AS (SELECT cohort, coalesce(field, '(all)') AS field, {_PRF} FROM c GROUP BY GROUPING SETS ((cohort, field), (cohort))) SELECT *, {_RATES} FROM s"
)


@query("split_cohort_eval", _COHORTS)
def split_cohort_eval(spark, sf_dir):
    keyed = outcomes(spark, sf_dir).withColumn("key", F.col("doc_id").cast("string"))
    return ev.summed(ev.with_cohorts(keyed, "key"), ["cohort"])


@query("variant_evaluation", f"SELECT 'baseline' AS variant, * FROM ({_COHORTS}) UNION ALL SELECT 'enhanced' AS variant, * FROM ({_COHORTS.replace(BASELINE_RULES[0], ENHANCED_RULES[0]).replace(BASELINE_RULES[1], ENHANCED_RULES[1])})")
def variant_evaluation(spark, sf_dir):
    of = lambda rules: outcomes(spark, sf_dir, rules).withColumn("key", F.col("doc_id").cast("string"))
    return ev.compare_variants({"baseline": of(BASELINE_RULES), "enhanced": of(ENHANCED_RULES)}, "key")


_PAIRS = "pairs AS (SELECT o_orderkey AS row_id, o_orderstatus AS a, CASE o_orderkey % 5 WHEN 0 THEN upper(o_orderpriority) WHEN 1 THEN substr(o_orderpriority, 1, 5) || '  ' WHEN 2 THEN 'N/A' WHEN 3 THEN '' ELSE 'other' END AS predicted, CASE WHEN o_orderkey % 7 = 0 THEN ' none ' ELSE o_orderpriority END AS gold FROM orders)"


def _pairs(spark, sf_dir):
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    predicted = F.when(k % 5 == 0, F.upper(p)).when(k % 5 == 1, F.concat(F.substring(p, 1, 5), F.lit("  "))).when(k % 5 == 2, "N/A").when(k % 5 == 3, "").otherwise("other")
    return table(spark, sf_dir, "orders").select(k.alias("row_id"), predicted.alias("predicted"), F.when(k % 7 == 0, " none ").otherwise(p).alias("gold"))


@query(
    "string_match",
    f"""WITH {_PAIRS}, n AS (SELECT row_id, lower(trim(predicted)) AS p0, lower(trim(gold)) AS g0, predicted, gold FROM pairs),
    m AS (SELECT *, CASE WHEN p0 IN ('', 'n/a', 'na', 'none', 'null', '-') THEN '' ELSE p0 END AS p, CASE WHEN g0 IN ('', 'n/a', 'na', 'none', 'null', '-') THEN '' ELSE g0 END AS g FROM n)
    SELECT row_id, p AS predicted, g AS gold, p <> '' AND g <> '' AND (p = g OR (length(p) >= 5 AND contains(g, p)) OR (length(g) >= 5 AND contains(p, g))) AS matched, regexp_replace(lower(gold), '[^a-z0-9]+', '', 'g') AS bare FROM m""",
)
def string_match(spark, sf_dir):
    return _pairs(spark, sf_dir).select("row_id", tx.normalized(F.col("predicted")).alias("p"), tx.normalized(F.col("gold")).alias("g"), tx.soft_match(F.col("predicted"), F.col("gold")).alias("matched"), tx.alphanumeric(F.col("gold")).alias("bare")).withColumnsRenamed({"p": "predicted", "g": "gold"})


@query(
    "top1_evaluation",
    f"""WITH {_PAIRS}, n AS (SELECT row_id, CASE WHEN lower(trim(predicted)) IN ('', 'n/a') THEN '' ELSE lower(trim(predicted)) END AS p, CASE WHEN trim(gold) = 'none' THEN '' ELSE lower(gold) END AS g FROM pairs),
    o AS (SELECT CASE WHEN p <> '' AND g <> '' THEN CASE WHEN p = g OR contains(g, p) OR contains(p, g) THEN 'tp' ELSE 'mismatch' END WHEN p <> '' THEN 'fp' ELSE 'fn' END AS outcome FROM n WHERE p <> '' OR g <> ''),
    s AS (SELECT unnest(['priority', '(all)']) AS field, * FROM (SELECT count(*) FILTER (outcome = 'tp') AS tp, count(*) FILTER (outcome IN ('fp', 'mismatch')) AS fp, count(*) FILTER (outcome IN ('fn', 'mismatch')) AS fn, count(*) FILTER (outcome = 'tn') AS tn, count(*) AS scored FROM o)) SELECT *, {_RATES} FROM s""",
)
def top1_evaluation(spark, sf_dir):
    p = _pairs(spark, sf_dir).withColumn("accession", F.col("row_id").cast("string")).withColumn("field", F.lit("priority"))
    return ev.summed(ev.top1_outcomes(p.select("row_id", "accession", "field", "gold"), p.select("accession", "field", F.col("predicted").alias("value"))), [])


@query(
    "reviewed_scoring",
    """WITH g AS (SELECT o_custkey AS accession, o_orderkey AS row_id, CASE WHEN o_orderkey % 3 = 0 THEN 'verified' ELSE 'open' END AS review_status, o_orderpriority AS gold, CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority WHEN o_orderkey % 4 = 1 THEN 'x' END AS predicted FROM orders),
    f AS (SELECT accession, count(DISTINCT row_id) AS n, max(review_status) AS s FROM g GROUP BY accession), p AS (SELECT accession, max(predicted) AS predicted FROM g GROUP BY accession),
    w AS (SELECT accession, CASE WHEN n <> 1 THEN 'multiple_reference_rows_per_filing' WHEN s <> 'verified' THEN 'reference_not_reviewed' WHEN predicted IS NULL THEN 'canonical_prediction_missing' END AS why FROM f JOIN p USING (accession))
    SELECT CAST(accession AS VARCHAR) AS accession, NULL AS field, why AS outcome FROM w WHERE why IS NOT NULL UNION ALL SELECT CAST(accession AS VARCHAR), 'priority', CASE WHEN p.predicted = g.gold THEN 'tp' ELSE 'mismatch' END FROM w JOIN g USING (accession) JOIN p USING (accession) WHERE why IS NULL""",
)
def reviewed_scoring(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("accession"), k.alias("row_id"), F.when(k % 3 == 0, "verified").otherwise("open").alias("review_status"), F.lit("priority").alias("field"), F.col("o_orderpriority").alias("gold"), F.when(k % 4 == 0, F.col("o_orderpriority")).when(k % 4 == 1, "x").alias("predicted"))
    predictions = o.groupBy("accession", "field").agg(F.max("predicted").alias("value"))
    return ev.reviewed_outcomes(o, predictions)


@query(
    "evidence_agreement",
    """WITH q AS (SELECT CAST(l_orderkey AS VARCHAR) AS accession, l_returnflag AS field, p_name AS quote FROM lineitem JOIN part ON l_partkey = p_partkey), c AS (SELECT CAST(l_orderkey AS VARCHAR) AS accession, l_returnflag AS field, string_split(p_name, ' ')[1] AS value FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber % 2 = 0
      UNION ALL SELECT CAST(l_orderkey AS VARCHAR), l_returnflag, 'absent' FROM lineitem WHERE l_linenumber = 4),
    cells AS (SELECT accession, field, list(DISTINCT regexp_replace(lower(quote), '[^a-z0-9]+', '', 'g')) AS quotes FROM q GROUP BY ALL), v AS (SELECT DISTINCT accession, field, regexp_replace(lower(value), '[^a-z0-9]+', '', 'g') AS key FROM c),
    j AS (SELECT accession, field, count(key) AS nv, count(*) FILTER (len(list_filter(quotes, lambda x: contains(x, key))) > 0) AS ns FROM cells LEFT JOIN v USING (accession, field) GROUP BY ALL)
    SELECT field, count(*) AS n_cells, count(*) FILTER (nv > 0) AS n_covered, CAST(sum(nv) AS BIGINT) AS n_values, CAST(sum(ns) AS BIGINT) AS n_supported, round(sum(ns) / sum(nv), 6) AS supported, round(count(*) FILTER (nv > 0) / count(*), 6) AS covered FROM j GROUP BY field""",
)
def evidence_agreement(spark, sf_dir):
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    j = j.select(F.col("l_orderkey").cast("string").alias("accession"), F.col("l_returnflag").alias("field"), "p_name", "l_linenumber")
    c = j.where("l_linenumber % 2 = 0").select("accession", "field", F.split("p_name", " ")[0].alias("value")).unionByName(j.where("l_linenumber = 4").select("accession", "field", F.lit("absent").alias("value")))
    return ev.evidence_agreement(j.select("accession", "field", F.col("p_name").alias("quote")), c)


@query("date_parse", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS iso, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS parsed, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS found, strftime(o_orderdate, '%B %-d, %Y') AS written FROM orders")
def date_parse(spark, sf_dir):
    written = F.date_format("o_orderdate", "MMMM d, yyyy")
    later = F.when(F.year("o_orderdate") >= 2000, F.get(tx.dates_in(F.concat(F.lit("held on "), written, F.lit(" at noon"))), F.lit(0))).otherwise(F.to_date("o_orderdate").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").cast("string").alias("iso"), tx.date_of(written).cast("string").alias("parsed"), later.alias("found"), written.alias("written"))


@query("money_parse", "SELECT o_orderkey, round(o_totalprice, 2) AS amount, NULL::DOUBLE AS two FROM orders")
def money_parse(spark, sf_dir):
    price = F.format_number("o_totalprice", 2)
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.cash_of(F.concat(F.lit("of $ "), price, F.lit(" in cash"))).cast("double").alias("amount"), tx.cash_of(F.concat(F.lit("$1 or $"), price)).cast("double").alias("two"))


@query("json_passages", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_passages(spark, sf_dir):
    wrapped = F.concat(F.lit('{"a":[{"quote":'), F.to_json(F.create_map(F.lit("v"), F.get_json_object("props", "$.k"))), F.lit("}]}"))
    parsed = F.from_json(wrapped, "map<string,array<struct<quote:map<string,string>>>>")
    return table(spark, sf_dir, "events").select("event_id", F.get(parsed["a"], F.lit(0))["quote"]["v"].cast("long").alias("k"))


@query("context_windows", "SELECT doc_id, substr(text, greatest(1, 51 - 30), CASE WHEN length(text) > 0 THEN least(51 + 10 + 25, length(text) + 100) - greatest(1, 51 - 30) END) AS around FROM documents")
def context_windows(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.around(F.col("text"), F.lit(50), F.lit(60), 30, 25).alias("around"))


@query("parity_split", "SELECT CASE WHEN CAST('0x' || right(sha256(CAST(o_orderkey AS VARCHAR)), 1) AS INT) % 2 = 0 THEN 'development' ELSE 'comparison' END AS cohort, count(*) AS n FROM orders GROUP BY ALL")
def parity_split(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(tx.parity_cohort(F.col("o_orderkey").cast("string")).alias("cohort")).agg(F.count(F.lit(1)).alias("n"))


@query("month_windows", "WITH r AS (SELECT r_regionkey, DATE '2020-01-15' + r_regionkey * 10 AS s, DATE '2020-04-02' + r_regionkey * 40 AS e FROM region), m AS (SELECT *, unnest(generate_series(date_trunc('month', s), e, INTERVAL 1 MONTH)) AS m FROM r) SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, CAST(CAST(greatest(m, s) AS DATE) AS VARCHAR) AS window_start, CAST(CAST(least(last_day(m), e) AS DATE) AS VARCHAR) AS window_end FROM m")
def windows_of_months(spark, sf_dir):
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("r_regionkey"), F.expr("date_add(date'2020-01-15', r_regionkey * 10)").alias("s"), F.expr("date_add(date'2020-04-02', r_regionkey * 40)").alias("e"))
    return month_windows(r, "s", "e").select("r_regionkey", F.col("window_start").cast("string").alias("window_start"), F.col("window_end").cast("string").alias("window_end"))


_EVIDENCE = "screened AS (SELECT doc_id AS accession, '2024-01-01' AS filing_date, text, CASE WHEN regexp_matches(text, '(?i)licen[sc]e') THEN 'merger_completed' WHEN contains(text, '!!') THEN 'other' END AS event_type, 'in 2024 ' || substr(text, 1, 20) AS excerpt FROM documents)"


def _screened(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    kind = F.when(F.col("text").rlike("(?i)licen[sc]e"), "merger_completed").when(F.contains("text", F.lit("!!")), "other")
    evidence = F.when(kind.isNotNull(), F.array(F.struct(kind.alias("event_type"), F.concat(F.lit("in 2024 "), F.substring("text", 1, 20)).alias("excerpt"))))
    return d.select(F.col("doc_id").alias("accession"), F.lit("2024-01-01").alias("filing_date"), "text", evidence.alias("evidence"))


_QUEUE = "queue AS (SELECT accession, sha256(text) AS text_sha256, CASE event_type WHEN 'merger_completed' THEN 'high' WHEN 'other' THEN 'medium' ELSE 'low' END AS suggested_priority, coalesce(event_type, '') AS evidence_types, CASE WHEN event_type IS NULL THEN '' ELSE excerpt END AS suggested_evidence FROM screened)"


@query("screen_queue", f"WITH {_EVIDENCE}, {_QUEUE} SELECT * FROM queue")
def screen_queue(spark, sf_dir):
    return ev.screen(_screened(spark, sf_dir)).select("accession", "text_sha256", "suggested_priority", "evidence_types", "suggested_evidence")


@query("screen_carryover", f"WITH {_EVIDENCE}, {_QUEUE} SELECT accession, CASE WHEN accession % 3 = 0 THEN 'confirmed' ELSE '' END AS review_label FROM queue")
def screen_carryover(spark, sf_dir):
    s = _screened(spark, sf_dir)
    first = ev.screen(s).withColumn("review_label", F.lit("confirmed"))
    changed = first.withColumn("text_sha256", F.when(F.col("accession") % 3 == 0, F.col("text_sha256")).otherwise("old"))
    return ev.screen(s, changed).select("accession", "review_label")


@query("staleness_check", f"WITH {_EVIDENCE}, {_QUEUE} SELECT accession, CASE accession % 4 WHEN 0 THEN '' WHEN 1 THEN 'text_changed' WHEN 2 THEN 'quote_not_in_text' ELSE 'no_review_date' END AS problems FROM queue")
def staleness_check(spark, sf_dir):
    s = _screened(spark, sf_dir)
    k = F.col("accession") % 4
    q = ev.screen(s).join(s.select("accession", F.substring("text", 1, 4).alias("__q")), "accession").withColumn("review_label", F.lit("confirmed"))
    q = q.withColumn("text_sha256", F.when(k == 1, "old").otherwise(F.col("text_sha256"))).withColumn("confirmed_evidence", F.when(k == 2, "no such quote").otherwise(F.col("__q"))).withColumn("reviewed_at", F.when(k == 3, "soon").otherwise("2024-05-01"))
    return ev.stale_reviews(q, s)


@query("column_drift", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'only_left' WHEN c_custkey % 10 = 1 THEN 'only_right' ELSE 'c_name' END AS drift FROM customer WHERE c_custkey % 10 IN (0, 1, 2)")
def column_drift(spark, sf_dir):
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey") % 10
    right = c.where(k != 0).withColumn("c_name", F.when(k == 2, "x").otherwise(F.col("c_name")))
    return ev.column_drift(c.where(k != 1), right, "c_custkey", ["c_name", "c_mktsegment"])


@query("incremental_pending", "SELECT o_orderkey FROM orders WHERE o_orderkey % 4 <> 0 OR o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 500")
def incremental_pending(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    done = o.where("o_orderkey % 4 = 0").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "failed").otherwise("ok").alias("status"))
    return st.pending(o, done, "o_orderkey", limit=500)


def _top(field: str) -> str:
    return f"arg_max(value, (score, -pos)) FILTER (field = '{field}')"


_SECURITY_FIELDS = "field NOT IN ('click', 'view', 'purchase')"


@query(
    "quality_gates",
    f"""WITH {_MENTIONS}, g AS (SELECT accession AS event_id, {_top("click")} AS price, {_top("view")} AS expires, {_top("purchase")} AS party, arg_max(value, (score, -pos)) FILTER ({_SECURITY_FIELDS}) AS security, CAST(-quantile_disc(-40 * length(value), 0.5) AS BIGINT) AS median FROM mentions GROUP BY accession),
    f AS (SELECT *, list_filter([CASE WHEN NOT regexp_matches(coalesce(price, ''), '(?i)\\$\\s*[0-9,]+') THEN 'top1_offer_price_not_money' END, CASE WHEN NOT regexp_matches(coalesce(expires, ''), '(?i)\\b[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}\\b') THEN 'top1_expiration_date_not_calendar' END,
      CASE WHEN regexp_matches(party, '{AGENTS}') OR regexp_matches(trim(party), '{SHELLS}') THEN 'top1_offeror_is_agent_or_shell' END, CASE WHEN median < 300 THEN 'passage_median_lt_300' END], lambda x: x IS NOT NULL) AS failures FROM g)
    SELECT event_id, price AS top1_offer_price, expires AS top1_expiration_date, party AS top1_offeror, security AS top1_security_description, coalesce(median, 0) AS passage_len_median, array_to_string(failures, ',') AS failures, len(failures) = 0 AS ok FROM f""",
)
def quality_gates(spark, sf_dir):
    m = mentions(spark, sf_dir)
    hints = F.create_map(*[F.lit(x) for x in ("click", "offer_price", "view", "expiration_date", "purchase", "offeror")])
    facts = m.select(F.col("accession").alias("event_id"), F.col("pos").alias("fact_id"), F.coalesce(hints[F.col("field")], F.lit("security_description")).alias("field_hint"), F.col("value").alias("raw"), F.col("score").alias("rank_score"), F.lit(None).cast("double").alias("confidence"), F.lit("rule").alias("method"), F.repeat("value", 40).alias("passage"))
    out = sp.quality_gates(facts)
    return out.withColumn("failures", F.array_join("failures", ",")).withColumn("passage_len_median", F.col("passage_len_median").cast("long"))


@query("html_text")
def html_text(spark, sf_dir):
    return mk.texts(table(spark, sf_dir, "pages"), "page_id", "html")


@query("html_segments")
def html_segments(spark, sf_dir):
    return mk.segments(table(spark, sf_dir, "pages"), "page_id", "html")


@query(
    "path_status",
    f"WITH {TAGGED}, p(path, status, kind) AS (VALUES ('tender', 'implemented', 'tender_offer'), ('exchange', 'stub_not_implemented', 'exchange_offer'), ('rights', 'stub_not_implemented', 'rights_issue'), ('merger', 'stub_not_implemented', 'merger'), ('conversion', 'stub_not_implemented', 'conversion')), "
    "k AS (SELECT CASE WHEN event_type = 'tender_offer' THEN event_type WHEN list_contains(forms, 'S-4') THEN 'merger' ELSE 'conversion' END AS kind, count(*) AS n FROM tagged GROUP BY 1) SELECT path, status, coalesce(n, 0) AS n_events FROM p LEFT JOIN k USING (kind)",
)
def path_status(spark, sf_dir):
    """The events of the corpus by the path that their kind would take."""
    kind = F.when(F.col("event_type") == "tender_offer", F.col("event_type")).when(F.array_contains("forms", "S-4"), "merger").otherwise("conversion")
    return st.path_status(mvp.tag_events(events(spark, sf_dir)).withColumn("event_type", kind))
