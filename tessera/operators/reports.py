"""Small summary tables of extractions, samples and pipeline runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import as_rows, sorted_set, sorted_union
from ..functions.quantiles import medians
from ..functions.text import around, dates_in, spaces
from ..sources.sinks import write_report


def crosstab(df: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    """Rows of each pair, 0 where there are none; the columns are given, so one aggregation does."""
    return df.groupBy(row).agg(*[F.count_if(F.col(column).eqNullSafe(F.lit(v))).alias(str(v)) for v in values])


def by_folder_and_role(df: DataFrame, folder: str, role: str, ok: Column, size: str, key: str) -> DataFrame:
    """Count, good ones, total size and distinct keys of each folder and role."""
    return df.groupBy(folder, role).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(ok, F.lit(False))).alias("n_ok"), F.sum(size).alias("total"), F.count_distinct(key).alias("n_keys"))


def metadata_inventory(documents: DataFrame) -> DataFrame:
    """What each form has: rows, filings, pairs, dates, endings.

    Pairs are grouped first, then filings, then forms: pairs and filings are counted
    as rows, so no distinct count multiplies the documents, and documents that lie
    together by filing are not moved before they are few.
    """
    both = F.col("accession").isNotNull() & F.col("filename").isNotNull()
    pairs = documents.groupBy("form", "accession", "filename").agg(F.count(F.lit(1)).alias("n"), F.min("file_date").alias("low"), F.max("file_date").alias("high"), F.collect_set("doc_ext").alias("endings"))
    filings = pairs.groupBy("form", "accession").agg(F.sum("n").alias("n"), F.count_if(both).alias("n_pairs"), F.min("low").alias("low"), F.max("high").alias("high"), sorted_union(F.col("endings")).alias("endings"))
    return filings.groupBy("form").agg(
        F.sum("n").alias("n_rows"), F.count("accession").alias("n_filings"), F.sum("n_pairs").alias("n_pairs"),
        F.min("low").alias("first_date"), F.max("high").alias("last_date"), sorted_union(F.col("endings")).alias("endings"),
    )


def span_summary(spans: DataFrame, label: str = "label") -> DataFrame:
    return spans.groupBy(label).agg(F.count(F.lit(1)).alias("n_spans"), F.max("score").alias("max_score"))


def file_summary(spans: DataFrame, key: str, label: str = "label") -> DataFrame:
    """Spans, distinct labels and the best score of each file."""
    return spans.groupBy(key).agg(F.count(F.lit(1)).alias("n_spans"), sorted_set(F.col(label)).alias("labels"), F.max("score").alias("max_score"))


def mentions(texts: DataFrame, key: str, text: str, patterns: dict[str, str], before: int = 80, after: int = 120, most: int = 220) -> DataFrame:
    """For each pattern the number of mentions and the surroundings of the first, on one line."""
    t = F.coalesce(F.col(text), F.lit(""))
    cells = []
    for name, pattern in patterns.items():
        at = F.regexp_instr(t, F.lit(pattern))
        first = F.regexp_extract(t, pattern, 0)
        snippet = F.when(at > 0, F.substring(spaces(around(t, at - 1, at - 1 + F.length(first), before, after)), 1, most))
        cells.append(F.struct(F.lit(name).alias("pattern"), F.regexp_count(t, F.lit(pattern)).cast("long").alias("n"), snippet.alias("snippet")))
    return texts.select(key, F.explode(F.array(*cells)).alias("m")).select(key, "m.*")


def run_summary(documents: DataFrame, group: str, value: str) -> DataFrame:
    return medians(documents, value, group)


def artifact_funnel(stages: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Events that have each artifact, in order (event rows with a boolean for each)."""
    one = stages.agg(F.count(F.lit(1)).alias("events"), *[F.count_if(F.coalesce(f, F.lit(False))).alias(f) for f in flags])
    return as_rows(one, "artifact", "n_events", ["events", *flags], "long")


def readiness(facts: DataFrame, key: str, hints: Sequence[str], good: dict[str, Column]) -> DataFrame:
    """Of the events, in percent, those whose top fact of each hint has the shape it should (``good`` looks at ``raw``)."""
    best = facts.groupBy(key, "field_hint").agg(F.max_by("raw", F.struct("rank_score", -F.col("fact_id"))).alias("raw"))
    wide = best.groupBy(key).agg(*[F.bool_or((F.col("field_hint") == h) & good.get(h, F.lit(True))).alias(h) for h in hints])
    one = wide.agg(*[F.round(100 * F.avg(F.coalesce(h, F.lit(False)).cast("int")), 2).alias(h) for h in hints])
    return as_rows(one, "field_hint", "ready_pct", list(hints))


def date_recall(gold: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """How many gold dates (key, gold text) a set of candidate texts names, per tier and in all."""
    g = gold.select(key, dates_in(F.col("gold")).alias("g")).where(F.size("g") > 0)
    c = candidates.select(key, F.explode(F.array(F.lit("all"), F.col("tier"))).alias("tier"), F.explode(dates_in(F.col("value"))).alias("d")).groupBy(key, "tier").agg(F.collect_set("d").alias("c"))
    tiers = candidates.select(F.explode(F.array(F.lit("all"), F.col("tier"))).alias("tier")).distinct()
    total = g.agg(F.count(F.lit(1)).alias("n_gold"))
    hit = g.join(c, key).where(F.arrays_overlap("g", "c")).groupBy("tier").agg(F.count(F.lit(1)).alias("n_found"))
    return tiers.join(hit, "tier", "left").crossJoin(total).select("tier", F.coalesce("n_found", F.lit(0)).alias("n_found"), "n_gold", F.round(F.try_divide(F.coalesce("n_found", F.lit(0)), "n_gold"), 6).alias("recall"))  # one row on the right


def routed_labels(kind: Column, role: Column, summary: Sequence[str], cover: Sequence[str], default: Sequence[str]) -> Column:
    """The labels that a segment is searched for, by its kind and role."""
    listed = lambda names: F.array(*[F.lit(n) for n in names])
    return F.when(kind.isin("faq", "priority_section"), listed(summary)).when(role == "cover", listed(cover)).otherwise(listed(default))


def presence_audit(reference: DataFrame, candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of each field's reference values, how many cells have any candidate."""
    has = candidates.select(*keys).distinct().withColumn("has", F.lit(1))
    return reference.join(has, list(keys), "left").groupBy("field").agg(F.count(F.lit(1)).alias("n_cells"), F.count("has").alias("n_with_candidates"))


def method_comparison(texts: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """All dollar mentions of a filing against the cash amounts that its context supports."""
    raw = texts.select(key, F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"\$\s*\d")).cast("long").alias("n_mentions"))
    kept = terms.where("field = 'cash_amount'").groupBy(key).agg(F.count(F.lit(1)).alias("n_candidates"))
    return raw.join(kept, key, "left").withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0)))


def event_snapshot(events: DataFrame, segments: DataFrame, facts: DataFrame, gates: DataFrame, key: str = "event_id") -> DataFrame:
    """One row an event over the tables of all stages."""
    kinds = segments.groupBy(key).agg(F.count(F.lit(1)).alias("n_segments"), *[F.count_if(F.col("segment_kind") == k).alias(f"n_{k}") for k in ("priority_section", "toc_section", "faq", "full_doc")])
    counted = facts.groupBy(key).agg(F.count(F.lit(1)).alias("n_facts"))
    return events.select(key).join(kinds, key, "left").join(counted, key, "left").join(gates.select(key, "ok", "top1_offer_price", "top1_offeror"), key, "left").fillna(0)


def confirmed(queue: DataFrame, documents: DataFrame, problems: DataFrame) -> DataFrame:
    """Confirmed rows without a problem, in order of date and filing, with their text."""
    good = queue.where("review_label = 'confirmed'").join(problems.where("problems <> ''").select("accession"), "accession", "left_anti")
    return good.join(documents.select("accession", "text"), "accession").orderBy("filing_date", "accession")


def export_confirmed(queue: DataFrame, documents: DataFrame, problems: DataFrame, folder: str) -> None:
    """Write the confirmed filings into ``folder``: their texts as JSON lines and a manifest as one CSV file.

    A confirmed review with a problem (changed text, a quote that isn't in it, no
    date) fails the export before anything is written.
    """
    stale = problems.where("problems <> ''").orderBy("accession").limit(5).collect()
    if stale:
        raise ValueError("stale reviews: " + ", ".join(f"{r['accession']} ({r['problems']})" for r in stale))
    rows = confirmed(queue, documents, problems)
    rows.select("accession", "filing_date", "text").write.mode("overwrite").json(f"{folder}/documents")
    write_report(rows.select("accession", "filing_date", "text_sha256", "suggested_priority", "evidence_types", "reviewed_at", "confirmed_evidence"), f"{folder}/manifest")
