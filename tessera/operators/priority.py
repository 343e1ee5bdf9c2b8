"""Roles of an event's documents, the document chosen for each, and the event's cohort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COVERS, RECOMMENDATIONS = ("SC TO-T", "SC TO-T/A", "SC TO-I", "SC TO-I/A"), ("SC 14D9", "SC 14D9/A")
OFFER_TEXT, LETTER_TEXT = r"(?i)offer\s+to\s+purchase", r"(?i)letter\s+of\s+transmittal"
OFFER_TYPE, LETTER_TYPE, ANY_TYPE = r"(?i)ex-?99\.?\(?a\)?\.?\(?1\)?\.?\(?a\)?", r"(?i)ex-?99\.?\(?a\)?\.?\(?1\)?\.?\(?b\)?", r"(?i)ex-?99\.?\(?a\)?\.?\(?1\)?"


def _text(name: str) -> Column:
    return F.trim(F.coalesce(name, F.lit("")))


def roles(documents: DataFrame) -> DataFrame:
    """role and how it was found; the first case that fits."""
    own = F.coalesce("is_primary_form_doc", F.lit(False)) | ~F.coalesce("is_exhibit", F.lit(False))
    form, kind, about = _text("form"), _text("file_type"), _text("file_description")
    letter = about.rlike(LETTER_TEXT) | kind.rlike(LETTER_TYPE)
    role = F.when(form.isin(*COVERS) & own, "cover").when(form.isin(*RECOMMENDATIONS) & own, "sc_14d9").when(about.rlike(OFFER_TEXT) | kind.rlike(OFFER_TYPE), "otp").when(letter, "lot")
    method = F.when(F.col("role") == "otp", F.when(about.rlike(OFFER_TEXT), "file_description").otherwise("ex99_type")).when(F.col("role") == "lot", F.when(about.rlike(LETTER_TEXT), "file_description").otherwise("ex99_type"))
    return documents.withColumn("role", role).withColumn("role_method", method)


def inferable_offer() -> Column:
    """An HTML exhibit of the offer's kind that is neither a fee table nor a letter."""
    name, kind, about = F.lower(_text("filename")), _text("file_type"), F.lower(_text("file_description"))
    return kind.rlike(ANY_TYPE) & ~F.contains(about, F.lit("fee")) & (name.endswith(".htm") | name.endswith(".html")) & ~kind.rlike(LETTER_TYPE) & ~F.contains(about, F.lit("letter of transmittal"))


def priority_documents(documents: DataFrame) -> DataFrame:
    """The document of each role of an event.

    Offers: named so before typed so, and inferred ones (the exact type, then the
    latest sequence) only if there is no other; the other roles: no amendment
    before an amendment, then the earliest.
    """
    r = roles(documents)
    r = r.withColumn("role", F.coalesce("role", F.when(inferable_offer(), "otp"))).withColumn("role_method", F.when(F.col("role_method").isNull() & (F.col("role") == "otp"), "inferred").otherwise(F.col("role_method")))
    order = F.when(F.col("role") == "otp", F.when(F.col("role_method") == "file_description", 0).when(F.col("role_method") == "ex99_type", 1).otherwise(2)).otherwise(0)
    inferred = F.col("role_method") == "inferred"
    late = F.when(F.coalesce(inferred, F.lit(False)), -F.coalesce("sequence", F.lit(-1)))
    amended = F.when(F.col("role") != "otp", F.coalesce("is_amendment", F.lit(False)).cast("int"))
    when = F.when(F.col("role") != "otp", F.col("file_date"))
    w = Window.partitionBy("event_id", "role").orderBy(order, amended, when.asc_nulls_first(), late, F.col("accession"), F.col("sequence"), F.col("hit_id"))
    return r.where("role is not null").withColumn("__n", F.row_number().over(w)).where("__n = 1").select("event_id", "role", "role_method", "hit_id", "accession", "filename", "form", "file_date", "is_amendment")


def cohorts(documents: DataFrame) -> DataFrame:
    """What each event has, and its cohort."""
    chosen = priority_documents(documents)
    has = lambda role: F.coalesce(F.bool_or(F.col("role") == role), F.lit(False))
    flags = chosen.groupBy("event_id").agg(has("cover").alias("has_cover"), has("otp").alias("has_otp"), has("lot").alias("has_lot"), has("sc_14d9").alias("has_14d9"), F.max(F.when(F.col("role") == "otp", F.col("role_method"))).alias("otp_method"))
    events = documents.groupBy("event_id").agg(F.count_if(F.coalesce("is_amendment", F.lit(False))).alias("n_amendments"))
    out = events.join(flags, "event_id", "left").fillna(False, ["has_cover", "has_otp", "has_lot", "has_14d9"])
    cohort = F.when(F.col("has_cover") & F.col("has_otp") & F.col("has_14d9"), "gold").when(F.col("has_cover") & F.col("has_14d9"), "needs_otp_resolve").otherwise("incomplete")
    out = out.withColumn("cohort", cohort).withColumn("download_ready", F.col("has_cover") & F.col("has_otp"))
    return out.withColumn("otp_method", F.when(F.col("has_otp"), F.col("otp_method")).when(F.col("cohort") != "needs_otp_resolve", "missing"))


def cohort_index(cohorted: DataFrame) -> DataFrame:
    return cohorted.groupBy("cohort").agg(F.count(F.lit(1)).alias("n_events"), F.count_if("download_ready").alias("n_download_ready"), F.count_if(F.col("otp_method") == "inferred").alias("n_inferred"))
