"""Field values of event versions, upserts without MERGE, and the current view."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog_fields import PLACEHOLDERS
from ..functions.frames import latest_per_key
from .amendments import latest_version


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], keep: Sequence[str] = (), fill: Sequence[str] = ()) -> DataFrame:
    """``existing`` with ``incoming`` over it.

    keep: columns that an update leaves as they are; fill: columns that an update
    changes only to a value. The result is a new table: write it to a new path.
    """
    old, new = existing.withColumn("__old", F.lit(1)).alias("o"), incoming.withColumn("__new", F.lit(1)).alias("n")
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    there, arrived = F.col("o.__old").isNotNull(), F.col("n.__new").isNotNull()
    joined = old.join(new, on, "full_outer")
    out = []
    for c in existing.columns:
        o, n = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c in keys:
            value = F.coalesce(o, n)
        elif c in keep:
            value = F.when(there, o).otherwise(n)
        elif c in fill:
            value = F.coalesce(n, o)
        else:
            value = F.when(arrived, n).otherwise(o)
        out.append(value.alias(c))
    return joined.select(*out)


def insert_missing(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``existing`` and the rows of ``incoming`` whose key it lacks; the first of equal new keys."""
    fresh = incoming.dropDuplicates(list(keys)).join(existing.select(*keys), list(keys), "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))


def orphans(documents: DataFrame, events: DataFrame) -> DataFrame:
    """Events that documents name and the events table lacks."""
    return documents.where("event_id is not null").join(events.select("event_id"), "event_id", "left_anti").groupBy("event_id").agg(F.count(F.lit(1)).alias("n_documents"))


def with_sample(documents: DataFrame, sample: DataFrame, order: str) -> DataFrame:
    """Documents with the status and digest of their latest sample row."""
    last = latest_per_key(sample, ["accession", "filename"], F.desc(order))
    return documents.join(last.select("accession", "filename", "status", "content_sha1"), ["accession", "filename"], "left")


def field_values(tagged: DataFrame, versions: DataFrame) -> DataFrame:
    """What metadata alone says about each event's latest version, one row a field.

    All fields come from one join with the latest versions: each event is one
    row of an array of candidate values, which is then exploded.
    """
    latest = latest_version(versions).select("event_id", "version_no")
    entry = lambda name, value, method, sure, when, json=None: F.when(when, F.struct(F.lit(name).alias("field_name"), value.cast("string").alias("value_text"), (json if json is not None else F.lit(None).cast("string")).alias("value_json"), F.lit(method).alias("method"), F.lit(sure).alias("confidence")))
    always = F.lit(True)
    tickers = F.coalesce("tickers", F.array().cast("array<string>"))
    values = [
        entry("corporate_action_type", F.coalesce("event_type", "primary_form_family"), "derived", 0.9, always),
        entry("security_description", F.col("primary_entity"), "metadata", 0.6, F.col("primary_entity").isNotNull()),
        entry("ticker", F.get(tickers, F.lit(0)), "metadata", 0.55, F.size(tickers) > 0, F.to_json(tickers)),
        entry("notification_status", F.when(F.col("has_amendment"), "AMENDED").otherwise("ANNOUNCEMENT"), "derived", 0.5, always),
        *[entry(p, F.lit(None), "placeholder", 0.0, F.col("in_preferred")) for p in PLACEHOLDERS],
    ]
    rows = tagged.join(latest, "event_id").select("event_id", "version_no", F.explode(F.array_compact(F.array(*values))).alias("v"))
    return rows.select("event_id", "version_no", "v.*")


def current_fields(events: DataFrame, values: DataFrame, fields: DataFrame) -> DataFrame:
    """The view of events and their current values; the field table is small and fixed."""
    return values.join(F.broadcast(fields.select(F.col("field").alias("field_name"), "field_group", "source_class")), "field_name").join(events.select("event_id", "primary_entity", "event_type"), "event_id")


def notification_drafts(current: DataFrame) -> DataFrame:
    """One JSON payload an event: its current fields by name."""
    fields = F.map_from_entries(F.array_sort(F.collect_list(F.struct("field_name", "value_text"))))
    one = current.groupBy("event_id").agg(F.max("event_type").alias("event_type"), fields.alias("fields"))
    return one.select("event_id", F.to_json(F.struct("event_id", "event_type", "fields"), {"ignoreNullFields": "false"}).alias("payload"))
