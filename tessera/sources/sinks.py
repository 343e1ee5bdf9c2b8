"""Writers: tables, CSV reports and archives of rows, all through Spark's commit protocol."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def flat(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text, for formats without them."""
    return df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes])


def write_table(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def write_partitions(df: DataFrame, path: str, partition_by: str) -> None:
    """Only the partitions that ``df`` has are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition_by).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """One CSV file of a small table."""
    flat(df).coalesce(1).write.mode("overwrite").options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_rows(df: DataFrame, path: str) -> None:
    """A large table as CSV, in as many files as it has partitions."""
    flat(df).write.mode("overwrite").options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def sections(reports: dict[str, DataFrame]) -> DataFrame:
    """Reports of different columns below each other, tagged by name."""
    out = None
    for name, df in reports.items():
        tagged = flat(df).withColumn("section", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def flat_spans(predictions: DataFrame) -> DataFrame:
    """A row for each span of ``candidates`` (map of field to array of spans)."""
    ids = [c for c in predictions.columns if c != "candidates"]
    return predictions.select(*ids, F.explode("candidates").alias("field", "spans")).select(*ids, "field", F.posexplode("spans").alias("pos", "span")).select(*ids, "field", "pos", "span.*")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for tables that a query writes and reads again: in the shared folder that the session names, a temporary one only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = Path(tempfile.mkdtemp(prefix="tessera-work-")).as_uri()
    folder = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return folder


def truncate(spark: SparkSession, path: str, schema: str) -> None:
    """The table without rows, in the given shape."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
