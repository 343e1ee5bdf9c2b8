"""Incremental ingest: a file stream of hits, deduplicated, written once for each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import KeyedTable


def file_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def deduplicated(stream: DataFrame, key: str, time: str, delay: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark; the state is dropped with it, so a copy that comes later than ``delay`` passes again."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def append_new(target: str, key: str):
    """A batch function that appends rows whose key ``target`` lacks: a batch that is replayed adds nothing."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(target)
        fresh = batch.dropDuplicates([key])
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            fresh = fresh.join(spark.read.parquet(target).select(key), key, "left_anti")
        fresh.write.mode("append").parquet(target)

    return write


def run_available(stream: DataFrame, target: str, checkpoint: str, key: str) -> None:
    """Process what there is, then stop; the checkpoint remembers what was read."""
    query = stream.writeStream.foreachBatch(append_new(target, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def run_into(stream: DataFrame, table: KeyedTable, checkpoint: str) -> None:
    """Process what there is into a keyed table. A batch reads those parts of the table that its rows belong to, so its work doesn't grow with the others."""

    def write(batch: DataFrame, number: int) -> None:
        table.append_missing(batch)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
