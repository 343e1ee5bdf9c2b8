"""The run that writes all reports of a corpus, and its summary.

The documents and the sample's texts are each read once. Documents are never written:
their pass leaves the parts of filings (``corpus.filing_parts``) with all that a report
counts of documents. The events are made from these with their counts observed on the
way, and the counts of documents come from one pass over the parts. All reports follow
from the events, the counts and the texts' flags.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..catalog import FORMATS
from ..catalog_fields import FIELDS
from ..sources import sinks
from . import amendments as am
from . import corpus as co
from . import field_matrix as fm
from . import mvp, quality

REPORTS = (
    "schema_coverage event_type_coverage mvp_event_taxonomy mvp_corpus_gaps mvp_build_order datastore_field_catalog mvp_events mvp_selection_funnel data_quality_report dataset_overview form_counts events "
    "ground_truth_feasibility unusual_document_volume unusual_amendment_volume simple_amendment_examples complex_amendment_examples amendment_field_deltas"
).split()

# The order in which event types are built, what that takes, and the parts of a split.
BUILD_ORDER = (
    (1, "tender_offer", "Build event datastore + extraction + notification draft on SC TO-T + 14D9", True),
    (2, "exchange_offer", "Reclassify exchange language inside TO; add S-4 collection", False),
    (3, "merger", "Collect DEFM14A / S-4 / SC 13E-3; election-options benchmark", False),
    (4, "rights_issue", "Collect 424B* / S-3 rights offerings; record/ex/subscription fields", False),
    (5, "conversion", "Collect 8-K / prospectus conversion notices; ratio/price benchmark", False),
)
SPLIT = (("train", 0.70), ("validation", 0.15), ("test", 0.15))


def build_order(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(BUILD_ORDER), "phase int, mvp_event_type string, action string, corpus_ready boolean")


def split_table(spark: SparkSession, n_core: int) -> DataFrame:
    """How many events of the core each part gets; whole events, never documents, are split."""
    return spark.createDataFrame([(name, share, round(share * n_core)) for name, share in SPLIT], "split string, target_fraction double, approx_events long")


#: Each format of the catalog is counted in a column of the parts; any other tells parts apart.
KNOWN_FORMATS = tuple(sorted({*FORMATS.values(), "other"}))

#: Fields that all documents of a part share, so that its missing values are counted without them.
KEYS = ("accession", "form", "primary_cik")


def _parts(documents: DataFrame) -> DataFrame:
    """The parts of filings, with counts of formats and of missing values."""
    guess = F.col("format_guess")
    odd = F.when(~guess.isin(*KNOWN_FORMATS), guess)
    known = [F.count_if(F.coalesce(guess == k, F.lit(False))).alias(f"format_{k}") for k in KNOWN_FORMATS]
    missing = [F.count_if(c).alias(f"missing_{k}") for k, c in quality.missing().items() if k not in KEYS]
    return co.filing_parts(documents.withColumn("odd_format", odd), ("primary_cik", "odd_format"), [*known, *missing])


def _counts(parts: DataFrame) -> DataFrame:
    """Sums of documents by form, and by family and odd format, of one pass: ``by`` tells which."""
    parts = parts.select("*", *[F.when(F.col(k).isNull(), F.col("n")).otherwise(0).alias(f"missing_{k}") for k in KEYS])
    sums = [c for c in parts.columns if c == "n" or c.startswith(("format_", "missing_"))]
    sets = parts.groupingSets([["form"], ["odd_format", "form_family"]], "form", "odd_format", "form_family")
    by = F.when(F.grouping("form") == 0, "form").otherwise("format")
    return sets.agg(by.alias("by"), *[F.sum(c).alias(c) for c in sums], F.min("low").alias("low"), F.max("high").alias("high"))


def _by_format(counts: DataFrame) -> DataFrame:
    """Documents of each format and form family."""
    known = [F.col(f"format_{k}") for k in KNOWN_FORMATS]
    rest = F.col("n")
    for k in known:
        rest = rest - k
    cells = [F.struct(F.lit(k).alias("format_guess"), c.alias("n")) for k, c in zip(KNOWN_FORMATS, known)]
    rows = counts.where("by = 'format'").select("form_family", F.inline(F.array(*cells, F.struct(F.col("odd_format").alias("format_guess"), rest.alias("n")))))
    return rows.where("n > 0").groupBy("format_guess", "form_family").agg(F.sum("n").alias("n_documents"))


def run_reports(spark: SparkSession, documents: DataFrame, sample: DataFrame, root: str) -> DataFrame:
    """Writes a folder for each of REPORTS under ``root`` and returns the summary (metric, value).

    documents: a document table. sample: event_id, accession, form, is_amendment, status
    and text of documents that were fetched. The folders of earlier runs are replaced.
    """
    seen = Observation("events")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{root}/_{name}")
        return spark.read.parquet(f"{root}/_{name}")

    parts = kept(_parts(documents), "parts")
    counts = kept(_counts(parts), "counts")
    core, count = F.col("in_core"), lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    tagged = mvp.tag_events(co.events_of_parts(parts)).observe(
        seen, F.count(F.lit(1)).alias("n_events"), count(core).alias("mvp_event_count"), count(F.col("in_preferred")).alias("mvp_preferred_count"), count(core & F.col("has_14d9")).alias("mvp_with_14d9_count"),
        count(F.col("in_stretch")).alias("issuer_stretch_event_count"), count(F.col("amendment_band") == "simple").alias("amendment_eval_simple_count"), count(F.col("amendment_band") == "complex").alias("amendment_eval_complex_count"),
        count(core & (F.col("n_primary_docs") >= 1)).alias("notification_eval_count"),
    )
    events = kept(tagged, "events")
    names = [f.name for f in FIELDS if f.patterns]
    found = kept(fm.scans(sample, keep=("event_id", "accession", "form", "is_amendment")), "scans")
    forms = counts.where("by = 'form'")
    corpus = forms.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_documents"), F.min("low").cast("string").alias("first_file_date"), F.max("high").cast("string").alias("last_file_date"))
    absent = forms.agg(F.sum("n").alias("__total"), *[F.coalesce(F.sum(f"missing_{k}"), F.lit(0)).alias(k) for k in quality.missing()])
    keys = parts.agg(F.count_distinct("accession").alias("n_filings"), F.count_distinct("primary_cik").alias("n_issuers"))
    forms = forms.select("form", "n")
    matrix = kept(fm.field_matrix(events, found), "matrix")
    coverage = matrix.select("field", F.col("public_coverage_pct").alias("coverage_pct"))
    filings = found.groupBy("event_id", "accession", "is_amendment").agg(*[F.bool_or(n).alias(n) for n in names])
    quality_parts = {
        "missing_metadata": quality.missing_rows(absent), "leakage_risks": quality.leakage_risks(events), "missingness_taxonomy": mvp.missingness(spark, coverage),
        "format_distribution": _by_format(counts), "sample_download_status": sample.groupBy("status").agg(F.count(F.lit(1)).alias("n")),
    }
    made = {
        "schema_coverage": matrix, "event_type_coverage": fm.event_type_matrix(events, found), "mvp_event_taxonomy": mvp.event_type_table(spark), "mvp_corpus_gaps": mvp.corpus_gaps(spark, forms), "mvp_build_order": build_order(spark),
        "datastore_field_catalog": mvp.field_catalog(spark, coverage), "mvp_events": events.where("in_core"), "mvp_selection_funnel": mvp.selection_funnel(events), "data_quality_report": sinks.sections(quality_parts),
        "dataset_overview": co.overview_rows(corpus.crossJoin(keys), events), "form_counts": forms.orderBy(F.desc("n"), "form"), "events": events, "ground_truth_feasibility": mvp.benchmark_recommendation(spark, coverage),
        "unusual_document_volume": co.unusual_volume(events), "unusual_amendment_volume": events.orderBy(F.desc("n_amendment_filings"), "event_id").limit(15).select("event_id", "primary_entity", "n_amendment_filings", "n_documents"),
        "simple_amendment_examples": am.simple_amendments(events), "complex_amendment_examples": am.complex_amendments(events), "amendment_field_deltas": am.delta_summary(am.presence_deltas(filings, names)),
    }
    for name in REPORTS:
        large = name in ("events", "mvp_events")  # as many rows as the corpus has events: many files
        (sinks.write_rows if large else sinks.write_report)(made[name], f"{root}/{name}")
    told = {**corpus.first().asDict(), **seen.get}
    told |= {f"approx_{r['split']}_events": r["approx_events"] for r in split_table(spark, told["mvp_event_count"]).collect()}
    told |= {"n_text_events": found.select("event_id").where("event_id is not null").distinct().count(), "n_reports": len(REPORTS)}
    summary = spark.createDataFrame([(k, None if v is None else str(v)) for k, v in told.items()], "metric string, value string")
    sinks.write_report(summary, f"{root}/run_summary")
    return summary
