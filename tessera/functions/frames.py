"""Helpers that turn a common need into one DataFrame expression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .literals import matches_any_case


def argmax(value: Column, *order: Column) -> Column:
    """Aggregate: the value of the row that is greatest by ``order``; list tie-breakers last."""
    return F.max_by(value, F.struct(*order))


def latest_per_key(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def top_per_key(df: DataFrame, keys: Sequence[str], n: int, *order: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def sorted_set(value: Column) -> Column:
    """Aggregate: distinct values that aren't null, sorted."""
    return F.array_sort(F.collect_set(value))


def sorted_union(values: Column) -> Column:
    """Aggregate: distinct elements of an array column, sorted.

    The inner sets are merged before the outer ones are sorted, so partial
    aggregation keeps each group's state at its distinct arrays.
    """
    return F.array_sort(F.array_distinct(F.filter(F.flatten(F.collect_set(values)), lambda x: x.isNotNull())))


def value_counts(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    """Rows of each key, null included, the most frequent first."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)).orderBy(F.desc(name), *keys)


def as_rows(df: DataFrame, name: str, value: str, columns: Sequence[str], kind: str = "double") -> DataFrame:
    """Columns of each row as rows (name, value)."""
    ids = [c for c in df.columns if c not in columns]
    return df.select(*ids, *[F.col(c).cast(kind).alias(c) for c in columns]).unpivot(ids, list(columns), name, value)


def presence(patterns: dict[str, Sequence[str]], text: Column, hits: bool = True, low: Column | None = None) -> list[Column]:
    """``<name>_detected`` (and ``<name>_n_pattern_hits``) for each family of patterns, in one pass over the text.

    low: the text in lower case; then a pattern runs only where a literal that it needs is found.
    """
    out = []
    whole = F.coalesce(text, F.lit(""))
    for name, family in patterns.items():
        found = [whole.rlike(p) if low is None else matches_any_case(whole, low, p) for p in family]
        any_ = found[0]
        for f in found[1:]:
            any_ = any_ | f
        out.append(any_.alias(f"{name}_detected"))
        if hits:
            total = found[0].cast("int")
            for f in found[1:]:
                total = total + f.cast("int")
            out.append(total.alias(f"{name}_n_pattern_hits"))
    return out


def ratio(top: Column, bottom: Column) -> Column:
    """Null where the bottom is 0."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def precision_recall(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """precision, recall and f1; undefined ones are null."""
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    f1 = F.when(p.isNotNull() & r.isNotNull(), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)))
    return [F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1")]
