"""The report run reads documents and texts once and writes every report."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import report_run as rr
from tessera.plans.surrogate import documents
from tessera.sources import readers

SF = "/root/testdata/sf0.001"


def test_report_run(spark, tmp_path):
    rows, texts = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    docs = documents(spark, SF).cache()
    n_docs = docs.count()

    def counted(batches):
        for b in batches:
            rows.add(b.num_rows)
            yield b

    @F.udf("string")
    def read(text):
        texts.add(1)
        return text

    sample = spark.createDataFrame([
        ("005-00001", "1", "SC TO-T", False, "ok", "The tender offer. CUSIP 123456789."), ("005-00001", "2", "SC TO-T/A", True, "ok", "The tender offer was amended. Record date."),
        ("005-00002", "3", "S-4", False, "ok", "nothing"), ("005-00003", "4", "S-4", False, "failed", "CUSIP"), (None, "5", None, None, "ok", None),
    ], "event_id string, accession string, form string, is_amendment boolean, status string, text string")
    root = str(tmp_path / "run")
    summary = {r["metric"]: r["value"] for r in rr.run_reports(spark, docs.mapInArrow(counted, docs.schema), sample.withColumn("text", read.asNondeterministic()("text")), root).collect()}
    assert rows.value == n_docs and texts.value <= 5  # one scan of each
    assert summary["n_documents"] == str(n_docs) and summary["n_text_events"] == "2" and summary["n_reports"] == str(len(rr.REPORTS)) == "18"
    assert sorted(p.name for p in (tmp_path / "run").iterdir() if not p.name.startswith("_")) == sorted([*rr.REPORTS, "run_summary"])
    field = {r["field"]: r for r in readers.read_csv(spark, f"{root}/schema_coverage").collect()}
    assert field["cusip"]["public_coverage_pct"] == "50.0" and field["cusip"]["primary_source"] == "SC TO-T" and field["eligible_quantity"]["evidence_type"] == "internal_only"
    deltas = {r["field"] for r in readers.read_csv(spark, f"{root}/amendment_field_deltas").collect()}
    assert {"cusip", "record_date", "notification_status"} <= deltas
    parts = {r["section"] for r in readers.read_csv(spark, f"{root}/data_quality_report").collect()}
    assert parts == {"missing_metadata", "leakage_risks", "missingness_taxonomy", "format_distribution", "sample_download_status"}
    assert [(r["split"], r["approx_events"]) for r in rr.split_table(spark, 10).collect()] == [("train", 7), ("validation", 2), ("test", 2)]
