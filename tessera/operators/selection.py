"""Small selections and checks over filings: periods, exhibits, signals, stage readiness, run identity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evaluation import refuse


def screened(documents: DataFrame, status: str = "merger_event_language_found") -> DataFrame:
    """Documents that the screen found language in, by date and filing."""
    return documents.where(F.col("screen_status") == status).orderBy("filing_date", "accession")


def in_period(queue: DataFrame, start: str, end: str, priorities: Sequence[str] = ("high",), date: str = "filing_date", priority: str = "suggested_priority") -> DataFrame:
    """Rows of some priorities whose date lies in a period, both ends with it."""
    return queue.where(F.col(date).cast("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")) & F.col(priority).isin(*priorities))


def filing_exhibits(documents: DataFrame, filings: DataFrame) -> DataFrame:
    """The exhibits of ``filings`` that are pages or texts, data exhibits (EX-101) aside, each file once."""
    kind = F.upper(F.coalesce("file_type", F.lit("")))
    good = F.col("filename").isNotNull() & F.col("primary_cik").isNotNull() & F.col("format_guess").isin("html", "text")
    exhibit = F.coalesce("is_exhibit", F.lit(False)) | kind.startswith("EX-")
    mine = documents.join(filings.select("accession").distinct(), "accession", "left_semi")
    return mine.where(good & exhibit & ~kind.startswith("EX-101")).dropDuplicates(["accession", "filename"])


def exhibit_candidates(index: DataFrame, items: str = "items") -> DataFrame:
    """The files of a filing's index (array of name, type) that look like exhibits."""
    rows = index.select(*[c for c in index.columns if c != items], F.explode(items).alias("i")).select("*", F.lower(F.coalesce("i.name", F.lit(""))).alias("__name"), F.lower(F.coalesce("i.type", F.lit(""))).alias("__type"))
    looks = F.contains("__type", F.lit("ex-99")) | F.contains(F.replace("__name", F.lit("."), F.lit("")), F.lit("ex99")) | F.contains("__name", F.lit("offer")) | F.contains("__name", F.lit("transmittal"))
    return rows.where(looks).drop("__name", "__type").withColumns({"name": F.col("i.name"), "type": F.col("i.type")}).drop("i")


def event_signals(events: DataFrame) -> DataFrame:
    """What metadata says about an event without its texts."""
    return events.select(
        "event_id", F.lit(True).alias("corporate_action_type_meta"), (F.size(F.coalesce("tickers", F.array().cast("array<string>"))) > 0).alias("ticker_meta"),
        (F.coalesce("primary_entity", F.lit("")) != "").alias("security_description_meta"), F.coalesce("has_amendment", F.lit(False)).alias("notification_status_meta"), "primary_form_family",
    )


def with_signals(flags: DataFrame, events: DataFrame, suffix: str = "_m") -> DataFrame:
    """Text flags of events with the events' family and amendment and their signals; a name that both have gets the suffix."""
    out = flags.join(events.select("event_id", "primary_form_family", "has_amendment"), "event_id", "left")
    signals = event_signals(events)
    return out.join(signals.withColumnsRenamed({c: c + suffix for c in signals.columns if c != "event_id" and c in out.columns}), "event_id", "left")


def folder_spread(samples: DataFrame, folder: str, entity: str, year: str) -> DataFrame:
    """Of each folder its rows, and how many different entities and years they have; an empty name is no entity."""
    who = F.nullif(F.lower(F.trim(entity)), F.lit(""))
    return samples.groupBy(folder).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(who).alias("n_entities"), F.count_distinct(year).alias("n_years"))


def refuse_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """The same rows; reading fails if a key occurs twice."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    marked = df.join(counted, keys, "left")
    return refuse(marked, F.col("__n").isNotNull(), f"duplicate {', '.join(keys)}").drop("__n")


def refuse_other_run(done: DataFrame, selected: DataFrame, model: str, key: str = "accession", order: str = "pos") -> DataFrame:
    """``done``, the records of a run that is to go on; reading fails unless they are the first of ``selected``, in order, by the same model."""
    wanted = selected.select(F.col(order).alias("__pos"), F.col(key).alias("__key"))
    both = done.join(wanted, F.col(order) == F.col("__pos"), "left")
    bad = ~F.col("__key").eqNullSafe(F.col(key)) | ~F.col("model").eqNullSafe(F.lit(model))
    return refuse(both, bad, "the records are of another input or model").drop("__pos", "__key")


def text_inputs(reference: DataFrame, texts: DataFrame) -> DataFrame:
    """A row for each reference filing: how many rows name it, and whether its text is there and unchanged.

    reference: accession, input_hash; texts: accession, text. status: ok, missing, changed.
    """
    one = reference.groupBy("accession").agg(F.count(F.lit(1)).alias("reference_records"), F.max("input_hash").alias("input_hash"))
    found = one.join(texts.select("accession", F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256")), "accession", "left")
    return found.withColumn("status", F.when(F.col("text_sha256").isNull(), "missing").when(F.col("text_sha256") == F.col("input_hash"), "ok").otherwise("changed"))


def with_stub_events(events: DataFrame, documents: DataFrame) -> DataFrame:
    """``events`` and, for each event that only documents name, a row with nothing but its key."""
    lost = documents.where("event_id is not null").select("event_id").distinct().join(events.select("event_id"), "event_id", "left_anti")
    return events.unionByName(lost, allowMissingColumns=True)


def stage_readiness(inventory: DataFrame, raw: DataFrame, clean: DataFrame, segments: DataFrame, spans: DataFrame, reps: DataFrame) -> DataFrame:
    """One row an event of ``inventory`` (event_id, accession, filename): which stages' output is complete.

    raw: accession, filename, n_bytes; clean: accession, filename; segments: event_id,
    n_segments; spans: event_id, status, n_spans; reps: event_id, status. Downloads are
    complete if every document is there with some bytes, cleaning if every document
    that is there has a text.
    """
    keys = ["accession", "filename"]
    docs = inventory.join(raw.select(*keys, "n_bytes"), keys, "left").join(clean.select(*keys).distinct().withColumn("__clean", F.lit(True)), keys, "left")
    there = F.col("n_bytes").isNotNull()
    out = docs.groupBy("event_id").agg(
        F.bool_and(F.coalesce(F.col("n_bytes") > 0, F.lit(False))).alias("download"),
        (F.bool_or(there) & F.bool_and(F.coalesce("__clean", F.lit(False)) | ~there)).alias("cleanup"),
    )
    later = {
        "segment": segments.groupBy("event_id").agg(F.bool_or(F.col("n_segments") > 0).alias("segment")),
        "spans": spans.groupBy("event_id").agg(F.bool_or((F.col("status") == "ok") & (F.coalesce("n_spans", F.lit(0)) >= 0)).alias("spans")),
        "assemble": reps.groupBy("event_id").agg(F.bool_or(F.col("status") == "ok").alias("assemble")),
    }
    for name, df in later.items():
        out = out.join(df, "event_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out.withColumn("inventory", F.lit(True)).withColumn("load", F.col("assemble"))


def download_manifest(inventory: DataFrame, cached: DataFrame, results: DataFrame) -> DataFrame:
    """The status of each document: skipped if it is cached, else that of its download, else pending."""
    keys = ["accession", "filename"]
    out = inventory.join(cached.where("n_bytes > 0").select(*keys).distinct().withColumn("__cached", F.lit(True)), keys, "left").join(results.select(*keys, F.col("status").alias("__status"), "error"), keys, "left")
    held = F.coalesce("__cached", F.lit(False))
    return out.withColumn("status", F.when(held, "skipped").otherwise(F.coalesce("__status", F.lit("pending")))).withColumn("error", F.when(~held, F.col("error"))).drop("__cached", "__status")


#: Form prefixes of the tender subset that older loaders read.
TENDER_FORMS = ("SC TO-", "SC 14D9")


def tender_subset(documents: DataFrame) -> DataFrame:
    form = F.coalesce("form", F.lit(""))
    return documents.where(form.startswith(TENDER_FORMS[0]) | form.startswith(TENDER_FORMS[1]))


def write_with_subset(documents: DataFrame, path: str, subset: str) -> None:
    """The table, and its tender subset in step with it, which is read back from what was written."""
    documents.write.mode("overwrite").parquet(path)
    tender_subset(documents.sparkSession.read.parquet(path)).write.mode("overwrite").parquet(subset)


def collapsed(text: Column) -> Column:
    """White space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
