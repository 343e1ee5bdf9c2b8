"""op6: license notices in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..licenses import licenses

NUMBER, NAME = 6, "op6_licenses"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
