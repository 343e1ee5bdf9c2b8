"""The field matrix searches each text once."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import corpus as co
from tessera.operators import field_matrix as fm
from tessera.plans.surrogate import documents

SF = "/root/testdata/sf0.001"


def test_texts_are_searched_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text_of(text):
        read.add(1)
        return text

    rows = [("a", "SC TO-T", "CUSIP 123456789"), ("a", "S-4", "record date"), ("b", "S-4", "record date"), ("c", None, "payment date"), (None, "8-K", "payment date"), ("d", "8-K", None)]
    sample = spark.createDataFrame(rows, "event_id string, form string, text string").withColumn("status", F.lit("ok")).withColumn("text", text_of.asNondeterministic()("text"))
    got = {r["field"]: r for r in fm.field_matrix(co.event_table(documents(spark, SF)), fm.scans(sample)).collect()}
    assert read.value == len(rows)
    cell = lambda f: (got[f]["n_detected_events"], got[f]["n_events_denominator"], got[f]["primary_source"])
    assert cell("cusip") == (1, 4, "SC TO-T") and cell("record_date") == (2, 4, "S-4") and cell("payment_date") == (1, 4, "8-K")
    assert cell("isin") == (0, 4, "8-K")  # no form mentions it: the first by name
