"""Versions of events, the cadence of their filings, and what amendments change."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import latest_per_key


def event_versions(documents: DataFrame) -> DataFrame:
    """One version a filing, numbered by date (unknown dates last) and accession.

    Recomputed whole, so an earlier filing that arrives late gets its place.
    """
    filings = documents.where("event_id is not null and accession is not null").groupBy("event_id", "accession")
    filings = filings.agg(F.min("form").alias("form"), F.min("file_date").alias("file_date"), F.bool_or(F.coalesce("is_amendment", F.lit(False))).alias("is_amendment"))
    w = Window.partitionBy("event_id").orderBy(F.col("file_date").asc_nulls_last(), "accession")
    status = F.when(F.col("is_amendment"), "amended").otherwise("initial")
    return filings.select("event_id", F.row_number().over(w).alias("version_no"), "accession", "form", "file_date", "is_amendment", status.alias("version_status"))


def latest_version(versions: DataFrame) -> DataFrame:
    return latest_per_key(versions, ["event_id"], F.desc("version_no"))


def latest_version_lateral(versions: DataFrame, events: DataFrame) -> DataFrame:
    """The same by a correlated top-1 join, which the optimizer decorrelates."""
    versions.createOrReplaceTempView("__versions")
    events.createOrReplaceTempView("__events")
    return versions.sparkSession.sql(
        "SELECT e.event_id, v.version_no, v.accession, v.version_status FROM __events e JOIN LATERAL "
        "(SELECT version_no, accession, version_status FROM __versions x WHERE x.event_id = e.event_id ORDER BY version_no DESC LIMIT 1) v"
    )


def filing_cadence(documents: DataFrame) -> DataFrame:
    """Days since the event's filing before, and since its first."""
    filings = documents.groupBy("event_id", "accession", "form", "is_amendment").agg(F.min("file_date").alias("file_date"))
    w = Window.partitionBy("event_id").orderBy(F.col("file_date").asc_nulls_last(), "accession", "form", "is_amendment")
    whole = Window.partitionBy("event_id")
    return filings.select(
        "*",
        F.datediff("file_date", F.lag("file_date").over(w)).alias("days_since_prior_filing"),
        F.datediff("file_date", F.min("file_date").over(whole)).alias("days_since_first_filing"),
    )


def simple_amendments(events: DataFrame, n: int = 10) -> DataFrame:
    """Of events amended once, those with fewest documents (a report of ``n`` rows)."""
    return events.where("n_amendment_filings = 1").orderBy("n_documents", "event_id").limit(n)


def complex_amendments(events: DataFrame, n: int = 10) -> DataFrame:
    return events.where("has_amendment").orderBy(F.desc("n_amendment_filings"), "event_id").limit(n)


def presence_deltas(flags: DataFrame, fields: list[str]) -> DataFrame:
    """Fields whose presence differs between an event's first initial filing and each amendment.

    flags: event_id, accession, is_amendment and a boolean for each field.
    """
    base = latest_per_key(flags.where("not is_amendment"), ["event_id"], F.col("accession").asc())
    base = base.select("event_id", F.col("accession").alias("initial_accession"), *[F.col(f).alias(f"base_{f}") for f in fields])
    pairs = flags.where("is_amendment").join(base, "event_id")
    changed = F.array_compact(F.array(*[F.when(F.col(f) != F.col(f"base_{f}"), F.lit(f)) for f in fields]))
    return pairs.select("event_id", "initial_accession", F.col("accession").alias("amendment_accession"), changed.alias("fields_changed")).withColumn("n_fields_changed", F.size("fields_changed"))


def delta_summary(deltas: DataFrame) -> DataFrame:
    return deltas.select(F.explode("fields_changed").alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("n_pairs"))
