"""How often fields are mentioned: by field, by form, by event type, and best source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import as_rows, presence


def flagged(texts: DataFrame, patterns: dict[str, Sequence[str]], text: str, keep: Sequence[str]) -> DataFrame:
    """The ``keep`` columns and a boolean for each field, from one pass over the texts."""
    folded = texts.select(*keep, F.col(text).alias("__text"), F.lower(F.coalesce(text, F.lit(""))).alias("__low"))
    flags = presence(patterns, F.col("__text"), hits=False, low=F.col("__low"))
    return folded.select(*keep, *flags).withColumnsRenamed({f"{p}_detected": p for p in patterns})


def hit_counts(texts: DataFrame, patterns: dict[str, Sequence[str]], text: str, key: str) -> DataFrame:
    """(key, field, n_pattern_hits) rows."""
    folded = texts.select(key, F.col(text).alias("__text"), F.lower(F.coalesce(text, F.lit(""))).alias("__low"))
    wide = folded.select(key, *presence(patterns, F.col("__text"), low=F.col("__low"))).drop(*[f"{p}_detected" for p in patterns])
    return as_rows(wide.withColumnsRenamed({f"{p}_n_pattern_hits": p for p in patterns}), "field", "n_pattern_hits", list(patterns), "long")


def by_field(flags: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Rows with the field, and what share of all that is."""
    wide = flags.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(f).alias(f) for f in fields])
    return as_rows(wide, "field", "n_detected", fields, "long").withColumn("coverage_pct", F.round(100 * F.try_divide("n_detected", "n_rows"), 2))


def by_group(flags: DataFrame, fields: Sequence[str], group: str) -> DataFrame:
    """The same within each group; the flags are summed before they become rows."""
    wide = flags.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(f).alias(f) for f in fields])
    return as_rows(wide, "field", "n_detected", fields, "long").withColumn("coverage_pct", F.round(100 * F.try_divide("n_detected", "n_rows"), 2))


def any_of_group(flags: DataFrame, fields: Sequence[str], group: str) -> DataFrame:
    """A row each group: whether any of its rows has the field."""
    return flags.groupBy(group).agg(*[F.bool_or(f).alias(f) for f in fields])


def best_source(coverage: DataFrame, group: str) -> DataFrame:
    """For each field the group that mentions it most often; the first by name of equals."""
    w = coverage.groupBy("field").agg(F.max("coverage_pct").alias("coverage_pct"))
    return coverage.join(w, ["field", "coverage_pct"]).groupBy("field").agg(F.min(group).alias("best_source"), F.first("coverage_pct").alias("coverage_pct"))


def pivoted(coverage: DataFrame, group: str, values: Sequence[str]) -> DataFrame:
    """Fields by groups; the values are given, so no extra pass looks for them."""
    return coverage.groupBy("field").pivot(group, list(values)).agg(F.first("coverage_pct"))
