"""Search hits to documents, documents to events, and the overview tables."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import AMENDMENT_FORMS, FORM_FAMILIES, FORMATS
from ..functions.frames import latest_per_key, sorted_set, sorted_union, value_counts
from ..functions.quantiles import described
from ..functions.text import display_name_parts, filename_of_hit, first_or_null

NO_NUMBER = "NO_FILE_NUM:"


def lookup(table: dict[str, str], key: Column, default: str | None = None) -> Column:
    """A constant table as a map literal, which Catalyst folds into the projection."""
    mapped = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]
    return F.coalesce(mapped, F.lit(default)) if default is not None else mapped


def is_exhibit(file_type: Column, description: Column) -> Column:
    return F.upper(F.coalesce(file_type, F.lit(""))).startswith("EX-") | F.contains(F.upper(F.coalesce(description, F.lit(""))), F.lit("EXHIBIT"))


def is_amendment(form: Column) -> Column:
    return F.coalesce(form.isin(*AMENDMENT_FORMS) | form.endswith("/A"), F.lit(False))


def is_primary(form: Column, file_type: Column, exhibit: Column) -> Column:
    """The form itself, as its type says, hyphens and spaces aside."""
    bare = lambda c, *what: functools.reduce(lambda t, x: F.replace(t, F.lit(x), F.lit("")), what, c)
    same = (file_type == form) | (bare(file_type, "-") == bare(form, "-", " "))
    return ~exhibit & (F.coalesce(file_type, F.lit("")) != "") & F.coalesce(same, F.lit(False))


def records_from_hits(hits: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Nested search hits (``_id``, ``_source``) as flat records, one a hit; ``keep`` names columns to carry along."""
    s = lambda name: F.col(f"_source.{name}")
    name = display_name_parts(first_or_null(s("display_names")))
    base = hits.select(F.col("_id").alias("hit_id"), F.col("_source"), name.alias("name"), *keep)
    exhibit = is_exhibit(s("file_type"), s("file_description"))
    return base.select(
        "hit_id",
        s("adsh").alias("accession"),
        filename_of_hit(F.col("hit_id"), s("adsh")).alias("filename"),
        s("form").alias("form"),
        lookup(FORM_FAMILIES, s("form"), "other").alias("form_family"),
        F.coalesce(s("file_type"), F.lit("")).alias("file_type"),
        s("file_description").alias("file_description"),
        F.to_date(F.try_to_timestamp(s("file_date"))).alias("file_date"),
        s("sequence").try_cast("int").alias("sequence"),
        F.coalesce(s("ciks"), F.array().cast("array<string>")).alias("ciks"),
        F.coalesce(first_or_null(s("ciks")), F.col("name.cik")).alias("primary_cik"),
        F.col("name.entity_name").alias("entity_name"),
        F.coalesce(F.col("name.tickers"), F.array().cast("array<string>")).alias("tickers"),
        F.coalesce(s("file_num"), F.array().cast("array<string>")).alias("file_nums"),
        first_or_null(s("file_num")).alias("primary_file_num"),
        is_amendment(s("form")).alias("is_amendment"),
        exhibit.alias("is_exhibit"),
        is_primary(s("form"), s("file_type"), exhibit).alias("is_primary_form_doc"),
        *keep,
    )


def first_seen(records: DataFrame, key: str, *order: str) -> DataFrame:
    """One record a key: the first by ``order``, which must be total."""
    return latest_per_key(records, [key], *[F.col(c).asc_nulls_last() for c in order])


def document_table(records: DataFrame) -> DataFrame:
    """Records with their event, file ending and format."""
    low = F.lower(F.coalesce("filename", F.lit("")))
    tail = F.concat(F.lit("."), F.substring_index(low, ".", -1))
    common = tail.isin(*FORMATS) & F.endswith(low, tail)  # most names; the pattern decides on the rest
    ending = F.when(common, tail).otherwise(F.nullif(F.regexp_extract(low, r"(\.[a-z0-9]+)$", 1), F.lit("")))
    out = records.withColumn("event_id", F.coalesce("primary_file_num", F.concat(F.lit(NO_NUMBER), "accession"))).withColumn("doc_ext", ending)
    return out.withColumn("format_guess", lookup(FORMATS, F.col("doc_ext"), "other"))


def filing_parts(documents: DataFrame, keys: Sequence[str] = (), more: Sequence[Column] = ()) -> DataFrame:
    """A row for each event, filing, form, family, set of issuers and whether it is an amendment: nearly always one a filing.

    ``keys`` names further columns that tell parts apart, ``more`` further aggregates.
    Of the parts of a filing one is ``opens_filing``, and one of its amended and one of
    its other parts is ``opens_kind``, so filings are counted as rows that open one. Names
    and tickers are collected as pairs, as a filing has few.
    """
    order = F.struct(F.col("file_date").isNull().alias("n"), F.col("file_date").alias("d"), F.col("sequence").alias("s"), F.col("hit_id").alias("h"), F.col("entity_name").alias("e"))
    amended = F.coalesce(F.col("is_amendment"), F.lit(False)).alias("amended")
    parts = documents.groupBy("event_id", "accession", "form", "form_family", "ciks", amended, *keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.collect_set(F.struct("entity_name", "tickers")).alias("named"),
        F.min(F.when(F.coalesce("entity_name", F.lit("")) != "", order)).alias("first"),
        F.min("file_date").alias("low"),
        F.max("file_date").alias("high"),
        F.count_if(F.coalesce("is_exhibit", F.lit(False))).alias("exhibits"),
        F.count_if(F.coalesce("is_primary_form_doc", F.lit(False))).alias("primary"),
        *more,
    )
    before = F.lag("amended").over(Window.partitionBy("event_id", "accession").orderBy("amended"))
    there = F.col("accession").isNotNull()
    parts = parts.withColumn("before", before)
    return parts.select("*", (there & F.col("before").isNull()).alias("opens_filing"), (there & F.coalesce(F.col("before") != F.col("amended"), F.lit(True))).alias("opens_kind")).drop("before")


def event_table(documents: DataFrame) -> DataFrame:
    """One row an event: counts, sets, first entity, dates and span."""
    return events_of_parts(filing_parts(documents))


def events_of_parts(parts: DataFrame) -> DataFrame:
    """The event table of documents of which the parts of filings are known.

    Filings are counted as rows, so no distinct count multiplies the documents. Sets
    are collected as sets, so an event with thousands of documents carries only its
    distinct values. The first entity is that of the least (file date, accession,
    sequence, hit).
    """
    first = F.when(F.col("first").isNotNull(), F.struct("first.n", "first.d", F.col("accession").alias("a"), "first.s", "first.h", "first.e"))
    out = parts.groupBy("event_id").agg(
        F.sum("n").alias("n_documents"),
        F.count_if("opens_filing").alias("n_filings"),
        F.count_if(F.col("opens_kind") & F.col("amended")).alias("n_amendment_filings"),
        F.count_if(F.col("opens_kind") & ~F.col("amended")).alias("n_initial_filings"),
        sorted_set(F.col("form")).alias("forms"),
        sorted_set(F.col("form_family")).alias("form_families"),
        sorted_union(F.col("named.entity_name")).alias("entity_names"),
        F.min(first).getField("e").alias("primary_entity"),
        sorted_union(F.col("ciks")).alias("ciks"),
        sorted_union(F.flatten(F.array_compact("named.tickers"))).alias("tickers"),
        F.min("low").alias("first_file_date"),
        F.max("high").alias("last_file_date"),
        F.sum("exhibits").alias("n_exhibits"),
        F.sum("primary").alias("n_primary_docs"),
    )
    single = F.when(F.size("form_families") == 1, first_or_null(F.col("form_families"))).when(F.size("form_families") > 1, "mixed")
    return out.select(
        "*",
        (F.col("n_amendment_filings") > 0).alias("has_amendment"),
        single.alias("primary_form_family"),
        first_or_null(F.col("ciks")).alias("primary_cik"),
        F.datediff("last_file_date", "first_file_date").alias("event_span_days"),
    )


def filing_table(documents: DataFrame) -> DataFrame:
    """One row a filing of an event, null keys kept."""
    return documents.groupBy("event_id", "accession", "form", "form_family", "is_amendment").agg(F.count(F.lit(1)).alias("n_documents"), F.min("file_date").alias("file_date"))


def overview(documents: DataFrame, events: DataFrame) -> DataFrame:
    """Metric rows of the whole corpus."""
    d = documents.agg(
        F.count(F.lit(1)).alias("n_documents"), F.count_distinct("accession").alias("n_filings"), F.count_distinct("primary_cik").alias("n_issuers"),
        F.min("file_date").cast("string").alias("first_file_date"), F.max("file_date").cast("string").alias("last_file_date"),
    )
    return overview_rows(d, events)


def overview_rows(one: DataFrame, events: DataFrame) -> DataFrame:
    """The same from the one row of what is known of the documents."""
    e = events.agg(F.count(F.lit(1)).alias("n_events"), F.count_if("has_amendment").alias("n_amended_events"), F.round(100 * F.avg(F.col("has_amendment").cast("int")), 2).alias("pct_amended_events"))
    one = one.select("n_documents", "n_filings", "n_issuers", "first_file_date", "last_file_date").crossJoin(e)  # one row each
    return one.select(*[F.col(c).cast("string").alias(c) for c in one.columns]).unpivot([], one.columns, "metric", "value")


def monthly_volume(documents: DataFrame) -> DataFrame:
    return documents.where("file_date is not null").groupBy(F.trunc("file_date", "MM").alias("month"), "form_family").agg(F.count(F.lit(1)).alias("n_documents"))


def format_availability(documents: DataFrame) -> DataFrame:
    return value_counts(documents, "format_guess", "form_family", name="n_documents")


def shared_filenames(documents: DataFrame) -> DataFrame:
    """File names found in more than one filing."""
    return documents.where("filename is not null").groupBy("filename").agg(F.count_distinct("accession").alias("n_accessions"), F.count(F.lit(1)).alias("n_rows")).where("n_accessions > 1")


def documents_per_event(events: DataFrame) -> DataFrame:
    return described(events, "n_documents")


def unusual_volume(events: DataFrame, n: int = 15) -> DataFrame:
    """The events with most documents (a report of ``n`` rows); they are found by two columns, and only they are read whole."""
    most = events.orderBy(F.desc("n_documents"), "event_id").limit(n).select(F.col("event_id").alias("__most"))
    return events.join(F.broadcast(most), F.col("event_id").eqNullSafe(F.col("__most")), "left_semi").orderBy(F.desc("n_documents"), "event_id")


def issuer_counts(events: DataFrame) -> DataFrame:
    key = F.coalesce("primary_cik", "primary_entity", F.lit("unknown"))
    return events.groupBy(key.alias("issuer")).agg(F.count(F.lit(1)).alias("n_events"), F.sum("n_documents").alias("n_documents"))


def repeated_issuers(events: DataFrame) -> DataFrame:
    return issuer_counts(events).where("n_events > 1")
