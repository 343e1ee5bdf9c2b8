"""op10: the benchmark items that documents leak."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..decontamination import leaks

NUMBER, NAME = 10, "op10_decontamination"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
