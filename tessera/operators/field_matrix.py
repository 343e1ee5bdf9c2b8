"""The field matrix: how far each notification field is covered, by which source and on what evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import EVENT_TYPES
from ..catalog_fields import FIELDS, INTERNAL, Field, relevance
from ..functions.frames import as_rows
from .coverage import flagged

#: Fields that metadata tells for every event: (source, whether the event has it).
METADATA = {
    "ticker": ("EFTS display_names (metadata)", lambda: F.size(F.coalesce("tickers", F.array().cast("array<string>"))) > 0),
    "security_description": ("EFTS entity_name / filing text", lambda: F.coalesce(F.col("primary_entity") != "", F.lit(False))),
}


def scans(sample: DataFrame, fields: Sequence[Field] = FIELDS, text: str = "text", keep: Sequence[str] = ("event_id", "form")) -> DataFrame:
    """``event_id, form`` (or what ``keep`` names) and a flag for each field with patterns, of the sample's documents that were fetched (status ok)."""
    patterns = {f.name: f.patterns for f in fields if f.patterns}
    return flagged(sample.where("status = 'ok'"), patterns, text, list(keep))


def _summed(found: DataFrame, names: Sequence[str]) -> DataFrame:
    """Per event and form: documents, and how many of them mention each field. All that follows comes from these few rows."""
    return found.groupBy("event_id", "form").agg(F.count(F.lit(1)).alias("n_docs"), *[F.sum(F.col(n).cast("long")).alias(n) for n in names])


def _sampled(summed: DataFrame, names: Sequence[str]) -> DataFrame:
    """``field, n_sample, n_events, best_form``: events of the sample, how many mention the field, and the form that does most often (the first by name of equals).

    Sums by event and sums by form come from one aggregation, so that the texts are searched once.
    """
    by_event = F.grouping("event_id") == 0
    sets = summed.groupingSets([["event_id"], ["form"]], "event_id", "form").agg(by_event.alias("by_event"), F.sum("n_docs").alias("n_docs"), *[F.sum(n).alias(n) for n in names])
    event, form = F.col("by_event") & F.col("event_id").isNotNull(), ~F.col("by_event") & F.col("form").isNotNull()
    order = lambda n: F.when(form, F.struct((-F.col(n) / F.col("n_docs")).alias("rate"), "form"))
    cells = [F.struct(F.lit(n).alias("field"), F.count_if(event & (F.col(n) > 0)).alias("n_events"), F.min(order(n)).getField("form").alias("best_form")) for n in names]
    one = sets.agg(F.count_if(event).alias("n_sample"), F.array(*cells).alias("cells"))
    return one.select("n_sample", F.inline("cells"))


def field_matrix(events: DataFrame, found: DataFrame, fields: Sequence[Field] = FIELDS) -> DataFrame:
    """A row for each field.

    Six rules, the first that holds: internal fields are never public; the event's
    type is known of every event; tickers and descriptions are counted over all events
    from metadata (with the share of texts that mention tickers in the note); fields
    without patterns aren't measured; without a fetched text nothing is; all others are
    counted over the events of the sample, an event having the field if one of its
    texts mentions it, and their source is the form that mentions it most often (the
    first by name of equals).
    """
    names = [f.name for f in fields if f.patterns]
    sample = _sampled(_summed(found, names), names)
    known = events.agg(F.count(F.lit(1)).alias("n_all"), *[F.count_if(has()).alias(f"n_{name}") for name, (_, has) in METADATA.items()])
    fixed = events.sparkSession.createDataFrame([(f.name, f.group, f.source_class, f.kind, f.difficulty, f.ground_truth, bool(f.patterns)) for f in fields], "field string, group string, source_class string, explicit_or_derived string, difficulty string, ground_truth_class string, has_patterns boolean")
    # The two other tables have one row, or one a field.
    rows = fixed.crossJoin(F.broadcast(known)).join(F.broadcast(sample), "field", "left")
    n_sample = F.coalesce("n_sample", F.lit(0))
    all_, events_, pct = F.col("n_all"), F.coalesce("n_events", F.lit(0)), lambda n, of: F.coalesce(F.round(100 * F.try_divide(n, of), 2), F.lit(0.0))
    text_rate = F.format_string("; sample_text_detection_pct=%.1f", F.bround(100 * F.try_divide(events_.cast("decimal(20,0)"), n_sample), 1).cast("double"))

    def row(cover: Column, missing: Column, n: Column, of: Column, note: Column | str, source: Column | str, evidence: str) -> Column:
        lit = lambda x: F.lit(x) if isinstance(x, str) else x
        return F.struct(cover.cast("double").alias("public_coverage_pct"), missing.cast("double").alias("missing_pct"), n.cast("long").alias("n_detected_events"), of.cast("long").alias("n_events_denominator"), lit(note).alias("denominator_note"), lit(source).alias("primary_source"), F.lit(evidence).alias("evidence_type"))

    zero, none = F.lit(0.0), F.lit(None)
    rule = F.when(F.col("source_class") == INTERNAL, row(zero, F.lit(100.0), zero, all_, "all_events_definitional_zero", "internal client", "internal_only"))
    rule = rule.when(F.col("field") == "corporate_action_type", row(F.when(all_ > 0, 100.0).otherwise(0.0), zero, all_, all_, "all_events_metadata", "EFTS form family", "observed_metadata"))
    for name, (source, _) in METADATA.items():
        n = F.col(f"n_{name}")
        note = F.concat(F.lit("all_events_metadata"), F.when(n_sample > 0, text_rate).otherwise("")) if name == "ticker" else "all_events_metadata"
        rule = rule.when(F.col("field") == name, row(pct(n, all_), F.round(100 - pct(n, all_), 2), n, all_, note, source, "observed_metadata"))
    rule = rule.when(~F.col("has_patterns"), row(zero, F.lit(100.0), zero, n_sample, "no_public_patterns_or_internal", "not measured", "not_measured"))
    rule = rule.when(n_sample == 0, row(none, none, zero, zero, "no_successful_text_sample", "insufficient sample", "not_measured"))
    rule = rule.otherwise(row(pct(events_, n_sample), F.round(100 - pct(events_, n_sample), 2), events_, n_sample, "sample_events_with_downloaded_text", F.coalesce("best_form", F.lit("sample text")), "inferred_regex_presence"))
    return rows.select("field", "group", rule.alias("r"), "explicit_or_derived", "difficulty", "source_class", "ground_truth_class").select("field", "group", "r.*", "explicit_or_derived", "difficulty", "source_class", "ground_truth_class")


def event_type_matrix(events: DataFrame, found: DataFrame, fields: Sequence[Field] = FIELDS) -> DataFrame:
    """Fields by form family over the events of the sample: coverage, how many events, relevance and evidence."""
    names = [f.name for f in fields if f.patterns]
    of_event = _summed(found, names).where("event_id is not null").groupBy("event_id").agg(*[(F.max(n) > 0).alias(n) for n in names])
    family = F.coalesce("primary_form_family", F.lit("unknown"))
    joined = of_event.join(events.select("event_id", family.alias("family")), "event_id", "left").withColumn("family", F.coalesce("family", F.lit("unknown")))
    wide = joined.groupBy("family").agg(F.count(F.lit(1)).alias("n_sample_events"), *[F.sum(F.col(n).cast("long")).alias(n) for n in names])
    wide = wide.select("*", *[F.lit(None).cast("long").alias(f.name) for f in fields if not f.patterns])
    rows = as_rows(wide, "field", "n", [f.name for f in fields], "long")
    internal = [f.name for f in fields if f.source_class == INTERNAL]
    is_internal, is_type = F.col("field").isin(*internal), F.col("field") == "corporate_action_type"
    cover = F.when(is_internal, 0.0).when(is_type, 100.0).otherwise(F.round(100 * F.try_divide("n", "n_sample_events"), 2))
    evidence = F.when(is_internal, "internal_only").when(is_type, "observed_metadata").when(F.col("n").isNotNull(), "inferred_regex_presence").otherwise("not_measured")
    table = events.sparkSession.createDataFrame([(t, f.name, relevance(t, f.name)) for t in EVENT_TYPES for f in fields], "family string, field string, relevance_assumption string")
    rows = rows.select("family", "field", cover.alias("coverage_pct"), "n_sample_events", evidence.alias("evidence_type")).join(F.broadcast(table), ["family", "field"], "left")
    return rows.select(F.col("family").alias("corporate_action_type"), "field", "coverage_pct", "n_sample_events", "evidence_type", F.coalesce("relevance_assumption", F.lit("relevant")).alias("relevance_assumption"))


def source_preference(found: DataFrame, fields: Sequence[Field] = FIELDS) -> DataFrame:
    """For each field and form the share of fetched documents that mention the field."""
    names = [f.name for f in fields if f.patterns]
    of_form = _summed(found, names).where("form is not null").groupBy("form").agg(F.sum("n_docs").alias("n_docs"), *[F.sum(n).alias(n) for n in names])
    rows = as_rows(of_form, "field", "n", names, "long")
    return rows.select("field", "form", F.round(100 * F.col("n") / F.col("n_docs"), 2).alias("doc_detection_rate_pct"), "n_docs")
