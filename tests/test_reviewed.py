"""Filings with several reference rows are told by one aggregation; only the others' cells are joined."""

from __future__ import annotations

from tessera.operators import evaluation as ev


def test_only_single_rows_are_compared(spark):
    rows = [(f"many{i}", i * 10 + k, "verified", "a", "x") for i in range(20) for k in range(3)]
    rows += [("one", 1, "verified", "a", "x"), ("one", 1, "verified", "b", "y"), ("open", 2, "open", "a", "x"), ("none", 3, "verified", "a", "x"), ("unsaid", 4, "verified", "a", "x"), ("noid", None, "verified", "a", "x"), (None, 5, "verified", "a", "x")]
    reference = spark.createDataFrame(rows, "accession string, row_id long, review_status string, field string, gold string")
    said = [*[(f"many{i}", "a", "x") for i in range(20)], ("one", "a", "X"), ("one", "b", "z"), ("open", "a", "x"), ("none", "other", "x"), ("noid", "a", "x"), (None, "a", "x")]
    predictions = spark.createDataFrame(said, "accession string, field string, value string")
    got = sorted((r["accession"], r["field"] or "", r["outcome"]) for r in ev.reviewed_outcomes(reference, predictions).collect())
    many = "multiple_reference_rows_per_filing"
    assert got == sorted([*[(f"many{i}", "", many) for i in range(20)], ("noid", "", many), ("one", "a", "tp"), ("one", "b", "mismatch"), ("open", "", "reference_not_reviewed"), ("none", "", "canonical_prediction_missing")])
    plan = ev.reviewed_outcomes(reference, predictions)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= 7
