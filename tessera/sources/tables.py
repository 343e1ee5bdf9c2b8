"""Keyed tables in partitions, of which a change reads and replaces only those that it touches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.datastore import upsert

PART = "part"


class KeyedTable:
    """Parquet in folders ``part=...``; every key lies in one part, told by the key's row alone.

    part: an expression over columns that a key never changes (by default the key's
    hash, in ``buckets`` parts). What a key's rows share with few others, such as a
    month or a range of numbers, makes changes touch few parts. The parts of a change
    come to the driver (at most as many as the table has), so the scan names them and
    no other folder is listed or read; changed parts are replaced by Spark's dynamic
    overwrite, which reads the old files before it moves the new ones in.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], part: Column | None = None, buckets: int = 64):
        self.spark, self.path, self.keys = spark, path, list(keys)
        self.part = part if part is not None else F.pmod(F.xxhash64(*keys), F.lit(buckets))

    def exists(self) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def placed(self, df: DataFrame) -> DataFrame:
        return df.withColumn(PART, self.part.cast("string"))

    def touched(self, placed: DataFrame) -> list[str]:
        return [r[0] for r in placed.select(PART).distinct().collect()]

    def read(self, parts: Sequence[str] | None = None) -> DataFrame:
        """The rows, of some parts only if they are given."""
        found = self.spark.read.parquet(self.path).schema
        shape = StructType([StructField(PART, StringType()) if f.name == PART else f for f in found])  # folder names as they are, not as numbers or days
        df = self.spark.read.schema(shape).parquet(self.path)
        return df if parts is None else df.where(F.col(PART).isin(list(parts)))

    def write(self, df: DataFrame) -> None:
        """The whole table anew; rows are gathered by part, so that a part is few files."""
        self._put(self.placed(df), "overwrite", "static")

    def append_missing(self, incoming: DataFrame) -> None:
        """Rows whose key the table lacks, the first of equal new keys. A batch that comes again adds nothing."""
        new = self.placed(incoming).dropDuplicates(self.keys).persist()  # read for its parts and again for its rows
        fresh = new
        if self.exists():
            old = self.read(self.touched(new)).select(*self.keys)
            on = [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in self.keys]
            fresh = new.alias("n").join(old.alias("o"), on, "left_anti")
        self._put(fresh, "append", "static")
        new.unpersist()

    def upsert(self, incoming: DataFrame, keep: Sequence[str] = (), fill: Sequence[str] = ()) -> list[str]:
        """``incoming`` over the table, see ``datastore.upsert``; the parts that were read and replaced."""
        placed = self.placed(incoming)
        parts = self.touched(placed)
        if parts:
            merged = upsert(self.read(parts), placed, self.keys, keep, fill) if self.exists() else placed
            self._put(merged, "overwrite", "dynamic")
        return parts

    def _put(self, placed: DataFrame, mode: str, overwrite: str) -> None:
        placed.repartition(F.col(PART)).write.mode(mode).option("partitionOverwriteMode", overwrite).partitionBy(PART).parquet(self.path)
