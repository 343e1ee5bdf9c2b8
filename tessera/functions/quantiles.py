"""Exact order statistics without holding values: histograms narrowed to the bucket that has the rank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1024


def _bucket(v: Column, low: Column, high: Column, turn: int, whole_numbers: bool) -> Column:
    """A number below BUCKETS that doesn't fall as v grows; the least and the greatest value never share one.

    In turn the buckets are of equal width, of equal ratio from the least value on, and
    of equal ratio from the greatest value down, so that values which crowd
    exponentially at an end are told apart as fast as others.
    """
    half = lambda c: c.cast("double") / 2  # noqa: E731 - so that no difference overflows
    gap = lambda a, b: F.coalesce(F.try_subtract(a, b).cast("double") / 2, half(a) - half(b)) if whole_numbers else half(a) - half(b)
    whole = gap(high, low)
    clean = lambda c: F.nanvl(F.coalesce(c, F.lit(0.0)), F.lit(0.0))
    ratio = lambda c: F.when(c > 0, 1 + F.log2(c) / 1075).otherwise(0.0)  # noqa: E731 - no positive double is less than 2**-1074
    if turn % 3 < 2:
        share = clean(F.try_divide(gap(v, low), whole))
        share = ratio(share) if turn % 3 else share
    else:
        share = 1 - ratio(clean(F.try_divide(gap(high, v), whole)))
    inner = F.floor(F.greatest(F.lit(0.0), F.least(share, F.lit(1.0))) * (BUCKETS - 2))
    return F.when(v >= high, F.lit(BUCKETS - 1)).otherwise(inner.cast("int"))


def order_statistics(df: DataFrame, value: str, by: Sequence[str], ranks: dict[str, Column]) -> DataFrame:
    """``by``, ``n`` (values that aren't null) and for each name the value of a rank, an expression over ``n``, from 0.

    Each round counts the values of every group's open intervals in BUCKETS buckets
    (which partial aggregation bounds), and narrows each rank's interval to the values
    of the bucket that holds it, until it is one value: two or three rounds for values
    that are spread at all evenly. A round reads ``df`` once. Groups without values
    have no row; null keys are a group.
    """
    from ..sources.sinks import work_folder

    spark = df.sparkSession
    keys = [f"k{i}" for i in range(len(by))]
    base = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(value).alias("v")).where("v is not null")
    kind = dict(base.dtypes)["v"] in ("tinyint", "smallint", "int", "bigint")
    folder, count = work_folder(spark, "ranks"), 0

    def cut(table: DataFrame) -> DataFrame:
        nonlocal count
        count += 1
        table.write.parquet(f"{folder}/{count}")
        return spark.read.schema(table.schema).parquet(f"{folder}/{count}")

    def same(a: str, b: str, names: Sequence[str]) -> Column:
        out = F.lit(True)
        for k in names:
            out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
        return out

    ends = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).where("n > 0")
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank")) for name, rank in ranks.items()]))
    targets = cut(ends.select(*keys, "n", "low", "high", wanted.alias("t")).select(*keys, "n", "low", "high", "t.name", "t.rank"))
    interval = [*keys, "low", "high"]
    while not (open_ := targets.where("low < high")).isEmpty():
        inside = base.alias("b").join(open_.select(*interval).distinct().alias("i"), same("b", "i", keys) & (F.col("b.v") >= F.col("i.low")) & (F.col("b.v") <= F.col("i.high")))
        bucket = _bucket(F.col("b.v"), F.col("i.low"), F.col("i.high"), count - 1, kind)
        hist = inside.groupBy(*[F.col(f"i.{c}").alias(c) for c in interval], bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("c"), F.min("b.v").alias("lo"), F.max("b.v").alias("hi"))
        before = F.coalesce(F.sum("c").over(Window.partitionBy(*interval).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        hist = hist.select(*interval, "c", "lo", "hi", before.alias("before"))
        holds = (F.col("t.rank") >= F.col("h.before")) & (F.col("t.rank") < F.col("h.before") + F.col("h.c"))
        narrow = open_.alias("t").join(hist.alias("h"), same("t", "h", interval) & holds).select(*[F.col(f"t.{k}") for k in keys], "t.n", F.col("h.lo").alias("low"), F.col("h.hi").alias("high"), "t.name", (F.col("t.rank") - F.col("h.before")).alias("rank"))
        targets = cut(narrow.unionByName(targets.where("not (low < high)")))
    found = targets.groupBy(*keys, "n").agg(*[F.max(F.when(F.col("name") == name, F.col("low"))).alias(name) for name in ranks])
    return found.select(*[F.col(k).alias(c) for k, c in zip(keys, by, strict=True)], "n", *ranks)


def described(df: DataFrame, value: str, *by: str) -> DataFrame:
    """``by`` and count, mean, standard deviation, least, exact quartiles (between neighbours linearly) and greatest."""
    c, n = F.col(value), F.col("n")
    places = {p: F.lit(q) * (n - 1) for p, q in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))}
    found = order_statistics(df, value, by, {f"{p}_{end}": f(at) for p, at in places.items() for end, f in (("low", F.floor), ("high", F.ceil))})

    def between(p: str, at: Column) -> Column:
        low, high = F.col(f"{p}_low").cast("double"), F.col(f"{p}_high").cast("double")
        return F.when(F.floor(at) == F.ceil(at), low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high).alias(p)

    quartiles = found.select(*[F.col(b).alias(f"q_{b}") for b in by], *[between(p, at) for p, at in places.items()])
    whole = df.groupBy(*by).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"))
    on = F.lit(True)
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"q_{b}"))
    return whole.join(quartiles, on, "left").select(*by, "n", "mean", "std", "min", "p25", "p50", "p75", "max")


def medians(df: DataFrame, value: str, *by: str) -> DataFrame:
    """``by``, the rows, the middle value (of an even number the greater of the two), and the median."""
    n = F.col("n")
    found = order_statistics(df, value, by, {"upper_median": F.floor(n / 2), "lower_median": F.floor((n - 1) / 2)})
    found = found.select(*[F.col(b).alias(f"q_{b}") for b in by], "upper_median", ((F.col("upper_median").cast("double") + F.col("lower_median").cast("double")) / 2).alias("median"))
    on = F.lit(True)
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"q_{b}"))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).join(found, on, "left").select(*by, "n", "upper_median", "median")
