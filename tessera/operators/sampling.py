"""Deterministic samples (each a report of stated size)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import top_per_key


def stratified(df: DataFrame, key: str, n: int, *order: Column) -> DataFrame:
    """The first n rows of each stratum."""
    return top_per_key(df, [key], n, *order)


def with_fallback(df: DataFrame, *levels: Column) -> DataFrame:
    """The rows of the strictest level that has any, found without a round trip to the driver."""
    rank = F.lit(len(levels))
    for k in range(len(levels) - 1, -1, -1):
        rank = F.when(F.coalesce(levels[k], F.lit(False)), F.lit(k)).otherwise(rank)
    ranked = df.withColumn("__rank", rank)
    least = ranked.agg(F.min("__rank").alias("__least"))
    return ranked.crossJoin(F.broadcast(least)).where("__rank = __least").drop("__rank", "__least")  # one row on the right


def diverse_per_period(df: DataFrame, period: str, entity: str, n: int, *order: Column) -> DataFrame:
    """n rows of each period: each entity's first row, then the others, by ``order``."""
    once = Window.partitionBy(period, entity).orderBy(*order)
    turn = F.when(F.row_number().over(once) == 1, 0).otherwise(1)
    return top_per_key(df.withColumn("__turn", turn), [period], n, F.col("__turn"), *order).drop("__turn")


class _Quota:
    """Rows taken in order while a quota lasts, with the entities that they used up."""

    def __init__(self) -> None:
        self.taken: dict[int, None] = {}
        self.entities: set[str] = set()

    def fill(self, rows: pd.DataFrame, entity: str, room: int, fresh: bool) -> int:
        """Take up to ``room`` rows, with ``fresh`` only those of unused or unnamed entities; how much room is left."""
        for row, who in rows[entity].items():
            if room <= 0:
                break
            if row not in self.taken and not (fresh and who and who in self.entities):
                self.taken[row] = None
                self.entities.add(who)
                room -= 1
        return room


def diverse_by_year(df: DataFrame, n: int, year: str, entity: str, order: list[str], filing: str | None = None) -> DataFrame:
    """n rows spread evenly over the years (the first years get what is left over), entities that no earlier year used first.

    A year that runs out of new entities takes others; what all years together
    lack, the earliest rows fill, new entities first. With ``filing`` only the first
    row of each filing counts. Rows without a year are left out; a null or empty
    entity is never used up.

    Every choice depends on those before it, so it is made in one task, on rows that
    are shown to suffice: at most n entities are ever used up, so a year's quota and
    the fill are met from the first rows of the first 3n entities (and unnamed rows)
    of a year and from the first 2n rows of each. The first 3n entities of all years
    are among these, as those before an entity in its first year come before it in all. Their
    number depends on n and the years alone, so each task looks for them in its own
    rows, batch by batch, and the rows are read once.
    """
    pool = df.where(F.col(year).isNotNull())
    if filing is not None:
        pool = top_per_key(pool, [filing], 1, *[F.col(c) for c in order])
    names = df.columns
    pool = pool.select(*names, F.coalesce(F.col(entity).cast("string"), F.lit("")).alias("__who"))

    columns = pool.columns

    def suffice(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([year, *order], kind="stable")
        fresh = rows[(rows["__who"] == "") | ~rows.duplicated([year, "__who"])]
        kept = fresh.groupby(year, sort=False).head(3 * n).index.union(rows.groupby(year, sort=False).head(2 * n).index)
        return rows.loc[rows.index.isin(kept)].reset_index(drop=True)

    def shortened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = suffice(batch.reset_index(drop=True) if held is None else pd.concat([held, batch], ignore_index=True))
        if held is not None:
            yield held

    def choose(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = pd.concat(list(shortened(rows)) or [pd.DataFrame(columns=columns)])
        if whole.empty:
            return
        years, quota = sorted(whole[year].unique()), _Quota()
        for k, of_year in enumerate(years):
            mine = whole[whole[year] == of_year]
            room = quota.fill(mine, "__who", n // len(years) + (k < n % len(years)), fresh=True)
            quota.fill(mine, "__who", room, fresh=False)
        room = quota.fill(whole, "__who", n - len(quota.taken), fresh=True)
        quota.fill(whole, "__who", room, fresh=False)
        yield whole.loc[list(quota.taken), names]

    return pool.mapInPandas(shortened, pool.schema).repartition(1).mapInPandas(choose, df.schema)


def choose_documents(hits: DataFrame, per_month: int | None = None) -> DataFrame:
    """One document a filing (the form itself before an EX-99, then the better score), the best of each month."""
    rank = F.when(F.col("file_type") == F.col("form"), 0).when(F.col("file_type").startswith("EX-99"), 1)
    pool = hits.where("cik is not null and document_id is not null").withColumn("__rank", rank).where("__rank is not null")
    one = top_per_key(pool, ["accession"], 1, F.col("__rank"), F.desc("score"), F.col("document_id"))
    if per_month is not None:
        one = top_per_key(one.withColumn("__month", F.trunc("filing_date", "MM")), ["__month"], per_month, F.desc("score"), F.col("accession")).drop("__month")
    return one.drop("__rank")


def needs_refresh(sample: DataFrame, least_forms: int = 4, least_rows: int = 20) -> DataFrame:
    """One row: whether a cached sample has too few forms or rows."""
    return sample.agg(((F.count_distinct("form") < least_forms) | (F.count(F.lit(1)) < least_rows)).alias("needs_refresh"))
