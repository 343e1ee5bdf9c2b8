"""Event cohorts, the selection funnel, and the field catalog with its decision tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import EVENT_TYPES
from ..catalog_fields import AUTOMATIC, BENCHMARK_FIELDS, FIELDS, INTERNAL, MANUAL, NEVER, UNCLEAR, WEAK, relevance
from ..functions.frames import as_rows
from .corpus import NO_NUMBER


def any_form(forms: Column, prefix: str) -> Column:
    return F.exists(F.coalesce(forms, F.array().cast("array<string>")), lambda f: f.startswith(prefix))


def tag_events(events: DataFrame) -> DataFrame:
    """Cohort flags of each event and its amendment band."""
    to_t, to_i, nine = (any_form(F.col("forms"), p) for p in ("SC TO-T", "SC TO-I", "SC 14D9"))
    out = events.select("*", to_t.alias("has_to_t"), to_i.alias("has_to_i"), nine.alias("has_14d9"), (~F.col("event_id").startswith(NO_NUMBER)).alias("has_file_num"))
    out = out.withColumn("event_type", F.when(F.col("has_to_t") | F.col("has_to_i"), "tender_offer").otherwise("unknown"))
    out = out.withColumn("in_core", F.col("has_to_t") & F.col("has_file_num"))
    out = out.withColumn("in_preferred", F.col("in_core") & F.col("has_14d9"))
    out = out.withColumn("in_stretch", F.col("has_to_i") & ~F.col("has_to_t") & F.col("has_file_num"))
    n, size = F.col("n_amendment_filings"), F.col("n_documents")
    core = F.col("in_core") & F.col("has_amendment")
    band = F.when(core & n.between(1, 5) & (size <= 60), "simple").when(core & ((n >= 6) | (size > 60)), "complex").when(core, "other_core").otherwise("out_of_core")
    return out.withColumn("amendment_band", band)


def load_tagged(spark: SparkSession, path: str) -> DataFrame:
    """The events of a catalog, tagged now if they were written without tags."""
    events = spark.read.parquet(path)
    return events if "in_preferred" in events.columns else tag_events(events)


def selection_funnel(tagged: DataFrame) -> DataFrame:
    stages = {
        "all_events": F.count(F.lit(1)),
        "has_file_number": F.count_if("has_file_num"),
        "core": F.count_if("in_core"),
        "preferred": F.count_if("in_preferred"),
        "preferred_with_amendments": F.count_if(F.col("in_preferred") & F.col("has_amendment")),
        "stretch": F.count_if("in_stretch"),
    }
    return as_rows(tagged.agg(*[v.alias(k) for k, v in stages.items()]), "stage", "n_events", list(stages), "long")


def event_type_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, list(p), list(s)) for k, (p, s) in EVENT_TYPES.items()], "event_type string, primary_forms array<string>, supporting_forms array<string>")


def corpus_gaps(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """Target forms of each event type against those that the corpus has."""
    present = documents.where("form is not null").agg(F.collect_set("form").alias("present"))
    joined = F.array_join
    names = lambda a: F.coalesce(F.nullif(joined(F.array_sort(a), ", "), F.lit("")), F.lit("(none)"))
    t = event_type_table(spark).crossJoin(present)  # one row on the right
    hit = F.array_intersect("primary_forms", "present")
    return t.select(
        "event_type",
        names(hit).alias("primary_forms_in_corpus"),
        names(F.array_intersect("supporting_forms", "present")).alias("supporting_forms_in_corpus"),
        names(F.array_except("primary_forms", "present")).alias("missing_primary_forms"),
        F.size(hit).cast("long").alias("n_primary_present"),
        F.size("primary_forms").cast("long").alias("n_primary_target"),
        F.round(100 * F.size(hit) / F.size("primary_forms"), 1).alias("primary_coverage_pct"),
    )


def field_table(spark: SparkSession) -> DataFrame:
    rows = [(f.name, f.group, f.source_class, f.kind, f.difficulty, f.ground_truth, bool(f.patterns), f.name in BENCHMARK_FIELDS) for f in FIELDS]
    return spark.createDataFrame(rows, "field string, field_group string, source_class string, kind string, difficulty string, ground_truth string, has_patterns boolean, in_benchmark boolean")


def relevance_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, f.name, relevance(t, f.name)) for t in EVENT_TYPES for f in FIELDS], "event_type string, field string, relevance string")


def field_catalog(spark: SparkSession, coverage: DataFrame) -> DataFrame:
    """Each field's role in a datastore; coverage: (field, coverage_pct)."""
    truth, source = F.col("ground_truth"), F.col("source_class")
    public = F.when(F.col("kind") == "derived", "derive_from_public").otherwise("extract_from_public")
    role = F.when(source == INTERNAL, "placeholder").when(source == UNCLEAR, "exclude_or_investigate").when(truth.isin(AUTOMATIC, WEAK), public).when(truth == MANUAL, "annotate_then_store").otherwise("exclude_or_investigate")
    ready = F.when(source == INTERNAL, "placeholder_only").when(source == UNCLEAR, "no_client_amount_without_position").when(truth == AUTOMATIC, "yes_metadata").when(truth == WEAK, "yes_with_caveat").when(truth == MANUAL, "after_annotation").otherwise("no")
    types = relevance_table(spark).where("relevance <> 'not_relevant'").groupBy("field").agg(F.array_join(F.array_sort(F.collect_list("event_type")), ",").alias("relevant_types"))
    return field_table(spark).join(F.broadcast(types), "field", "left").join(F.broadcast(coverage), "field", "left").select("field", "field_group", role.alias("role"), ready.alias("notification_ready"), "in_benchmark", F.coalesce("relevant_types", F.lit("")).alias("relevant_types"), "coverage_pct")


def missingness(spark: SparkSession, coverage: DataFrame) -> DataFrame:
    """Why a field is missing, from its coverage (field, coverage_pct) and relevance."""
    rel = relevance_table(spark).groupBy("field").agg(F.bool_and(F.col("relevance") == "not_relevant").alias("never"), F.bool_or(F.col("relevance") == "optional").alias("sometimes"))
    cov = F.col("coverage_pct")
    what = (
        F.when(F.col("source_class") == INTERNAL, "internal_only")
        .when(cov.isNull() | F.isnan(cov), "parsing_or_sample_gap")
        .when(F.col("source_class") == UNCLEAR, "unclear_or_partially_public")
        .when(cov >= 80, "usually_present_in_public_sample")
        .when(cov >= 20, "sometimes_present_in_public_sample")
        .when(F.col("never"), "not_relevant_for_observed_event_types")
        .when(F.col("sometimes"), "optional_for_many_events_or_absent")
        .otherwise("likely_relevant_but_rarely_detected")
    )
    return field_table(spark).join(F.broadcast(coverage), "field", "left").join(F.broadcast(rel), "field", "left").select("field", "field_group", "coverage_pct", what.alias("missingness"))


def benchmark_recommendation(spark: SparkSession, coverage: DataFrame) -> DataFrame:
    truth, cov = F.col("ground_truth"), F.coalesce("coverage_pct", F.lit(-1.0))
    what = (
        F.when(truth == AUTOMATIC, "include_in_benchmark")
        .when(truth == NEVER, "exclude_from_public_benchmark")
        .when((truth == WEAK) & (cov >= 50), "include_as_weak_proxy_only")
        .when((truth == MANUAL) & (cov >= 40), "prioritize_for_manual_annotation")
        .when(truth == MANUAL, "annotate_later_or_event_type_specific")
        .otherwise("investigate")
    )
    return field_table(spark).join(F.broadcast(coverage), "field", "left").select("field", "field_group", "coverage_pct", what.alias("recommendation"))
