"""A pattern's places take two scans of a text, not a third to see whether there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.arrays import matches


def test_two_scans(spark):
    df = spark.createDataFrame([("a1bb22",), ("none",), ("",), (None,)], "t string").select("t", matches(F.col("t"), "[0-9]+").alias("m"))
    assert "RLIKE" not in df._jdf.queryExecution().optimizedPlan().toString().upper()
    got = {r["t"]: [(m["start"], m["end"], m["value"]) for m in r["m"]] for r in df.collect()}
    assert got == {"a1bb22": [(1, 2, "1"), (4, 6, "22")], "none": [], "": [], None: []}
