"""The inventory of forms moves no documents that lie together by filing already."""

from __future__ import annotations

import datetime

from tessera.operators import reports as rp
from tessera.plans import report_queries
from tessera.plans.surrogate import documents

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_documents_are_neither_multiplied_nor_moved(spark):
    df = report_queries.metadata_inventory(spark, SF)
    assert "Expand" not in plan(df)
    assert plan(df).count("Exchange hashpartitioning") == plan(documents(spark, SF)).count("Exchange hashpartitioning") + 1  # that of the forms


def test_filings_of_a_documents_table_lie_together(spark):
    docs = documents(spark, SF)
    grouped = docs.groupBy("event_id", "accession").count()
    assert plan(grouped).count("Exchange hashpartitioning") == plan(docs).count("Exchange hashpartitioning")


def test_nulls_and_pairs(spark):
    day = datetime.date(2024, 1, 1)
    rows = [("S-4", "1", "a", day, ".htm"), ("S-4", "1", "a", None, ".txt"), ("S-4", "1", None, day, None), ("S-4", None, "a", day, ".htm"), ("S-4", "2", "a", day, None), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "form string, accession string, filename string, file_date date, doc_ext string")
    got = {r["form"]: tuple(r)[1:] for r in rp.metadata_inventory(docs).collect()}
    assert got == {"S-4": (5, 2, 2, day, day, [".htm", ".txt"]), None: (1, 0, 0, None, None, [])}
