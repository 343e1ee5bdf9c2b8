"""Missing metadata, inconsistent names, duplicates and leakage risks of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import as_rows
from .corpus import NO_NUMBER

METADATA = ("accession", "filename", "form", "file_date", "primary_cik", "entity_name", "primary_file_num")


def missing() -> dict[str, Column]:
    """For each field whether a document has no value, or an empty one."""
    return {**{c: F.col(c).isNull() for c in METADATA}, "tickers": F.coalesce(F.size("tickers"), F.lit(0)) <= 0}


def missing_metadata(documents: DataFrame) -> DataFrame:
    """Missing or empty values of each field, counted in one pass."""
    return missing_rows(documents.agg(F.count(F.lit(1)).alias("__total"), *[F.count_if(c).alias(k) for k, c in missing().items()]))


def missing_rows(one: DataFrame) -> DataFrame:
    """The same of the one row of counts and their ``__total``."""
    rows = as_rows(one, "field", "n_missing_or_empty", [*METADATA, "tickers"], "long")
    return rows.select("field", "n_missing_or_empty", F.round(100 * F.try_divide("n_missing_or_empty", "__total"), 2).alias("pct"))


def name_variance(documents: DataFrame) -> DataFrame:
    named = documents.where("primary_cik is not null and entity_name is not null")
    return named.groupBy("primary_cik").agg(F.count_distinct("entity_name").alias("n_distinct_names")).where("n_distinct_names > 1")


def duplicate_documents(documents: DataFrame) -> DataFrame:
    return documents.groupBy("accession", "filename").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def near_duplicate_content(contents: DataFrame, key: str, text: str, group: str) -> DataFrame:
    """Texts found more than once: how often, in how many groups, and the least key."""
    hashed = contents.select(key, group, F.sha1(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).alias("sha1"))
    return hashed.groupBy("sha1").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(group).alias("n_groups"), F.min(key).alias("first_key")).where("n > 1")


def leakage_risks(events: DataFrame) -> DataFrame:
    """What a split by documents, or without regard to issuers, would leak; an event knows its number of documents."""
    many = events.where("n_documents > 1").agg(F.count(F.lit(1)).alias("affected_events"), F.sum("n_documents").alias("affected_documents")).withColumn("risk", F.lit("document_level_random_split"))
    again = events.where("primary_cik is not null").groupBy("primary_cik").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    again = again.agg(F.count(F.lit(1)).alias("affected_events"), F.lit(None).cast("long").alias("affected_documents")).withColumn("risk", F.lit("issuer_repeated_across_splits"))
    weak = events.where(F.col("event_id").startswith(NO_NUMBER)).agg(F.count(F.lit(1)).alias("affected_events"), F.coalesce(F.sum("n_documents"), F.lit(0)).alias("affected_documents")).withColumn("risk", F.lit("weak_event_key_without_file_num"))
    return many.unionByName(again).unionByName(weak).select("risk", "affected_events", "affected_documents")
