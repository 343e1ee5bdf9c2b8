"""The parts of filings stand for the documents: events and counts from them are those of the documents themselves."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import functions as F

from tessera.operators import corpus as co
from tessera.operators import quality
from tessera.operators import report_run as rr
from tessera.plans.surrogate import documents

SF = "/root/testdata/sf0.001"
SCHEMA = (
    "hit_id string, accession string, filename string, form string, form_family string, file_date date, sequence int, ciks array<string>, primary_cik string, "
    "entity_name string, tickers array<string>, primary_file_num string, is_amendment boolean, is_exhibit boolean, is_primary_form_doc boolean"
)
D = date(2024, 1, 2)
ROWS = [
    ("h1", "a1", "x.htm", "S-4", "f", D, 1, ["1"], "1", "B", ["T"], "n1", False, False, True),
    ("h2", "a1", "x.pdf", "S-4/A", "f", D, 2, ["1"], "1", "b", None, "n1", True, True, False),  # both kinds in one filing, no tickers known
    ("h3", "a1", None, "S-4", "f", None, 3, ["1", "2"], "1", None, [], "n1", None, None, None),
    ("h4", "a2", "y.odd", None, None, D, None, None, None, "A", ["T", "U"], "n1", True, False, False),  # as early as a1, but the later accession
    ("h5", "a2", "y", "S-4", "f", D, 1, ["3"], "3", "", ["V"], "n2", True, False, False),  # a filing of two events
    ("h6", None, "z.txt", "8-K", "g", D, 1, ["3"], "3", "C", ["W"], "n2", False, False, True),  # no filing
    ("h7", "a3", "z.htm", "8-K", "g", D, 1, ["3"], "3", None, None, None, False, True, False),
    ("h8", None, "z.htm", "8-K", "g", D, 1, ["3"], "3", "E", ["X"], None, False, True, False),  # no event
]


def test_events_and_counts_of_odd_rows(spark):
    docs = co.document_table(spark.createDataFrame(ROWS, SCHEMA))
    docs = docs.withColumn("format_guess", F.when(F.col("hit_id") == "h5", "scroll").when(F.col("hit_id") == "h7", None).otherwise(F.col("format_guess")))
    rows = [r.asDict() for r in docs.collect()]
    parts = rr._parts(docs).cache()
    got = {r["event_id"]: r for r in co.events_of_parts(parts).collect()}
    assert set(got) == {"n1", "n2", "NO_FILE_NUM:a3", None} and len(got) == len({r["event_id"] for r in rows})
    for key, e in got.items():
        mine = [r for r in rows if r["event_id"] == key]
        filed = lambda kind: {r["accession"] for r in mine if r["accession"] and kind(r)}  # noqa: B023, E731
        union = lambda c: sorted({x for r in mine for x in r[c] or []})  # noqa: B023, E731
        named = [r for r in mine if r["entity_name"]]
        least = min(named, key=lambda r: (r["file_date"] is None, r["file_date"] or D, r["accession"] or "", -1 if r["sequence"] is None else r["sequence"], r["hit_id"]), default={"entity_name": None})
        assert e["n_documents"] == len(mine) and e["n_filings"] == len(filed(lambda r: True))
        assert e["n_amendment_filings"] == len(filed(lambda r: r["is_amendment"])) and e["n_initial_filings"] == len(filed(lambda r: not r["is_amendment"]))
        assert e["forms"] == sorted({r["form"] for r in mine if r["form"]}) and e["entity_names"] == sorted({r["entity_name"] for r in mine if r["entity_name"] is not None})
        assert e["ciks"] == union("ciks") and e["tickers"] == union("tickers") and e["primary_entity"] == least["entity_name"]
        assert e["n_exhibits"] == sum(bool(r["is_exhibit"]) for r in mine) and e["n_primary_docs"] == sum(bool(r["is_primary_form_doc"]) for r in mine)
    counts = rr._counts(parts).cache()
    listed = lambda df: sorted(map(str, df.collect()))
    assert listed(rr._by_format(counts).select("format_guess", "form_family", "n_documents")) == listed(docs.groupBy("format_guess", "form_family").agg(F.count(F.lit(1)).alias("n_documents")))
    assert listed(counts.where("by = 'form'").select("form", "n")) == listed(docs.groupBy("form").agg(F.count(F.lit(1)).alias("n")))
    absent = counts.where("by = 'form'").agg(F.sum("n").alias("__total"), *[F.sum(f"missing_{k}").alias(k) for k in quality.missing()])
    assert listed(quality.missing_rows(absent)) == listed(quality.missing_metadata(docs))


def test_a_run_writes_parts_and_no_documents(spark, tmp_path):
    docs = documents(spark, SF)
    sample = spark.createDataFrame([("005-00001", "1", "S-4", False, "ok", "CUSIP")], "event_id string, accession string, form string, is_amendment boolean, status string, text string")
    rr.run_reports(spark, docs, sample, str(tmp_path / "run"))
    assert not (tmp_path / "run" / "_documents").exists()
    parts = spark.read.parquet(str(tmp_path / "run" / "_parts"))
    assert parts.agg(F.sum("n")).first()[0] == docs.count() and parts.count() < docs.count() / 2


def test_endings_are_those_of_the_pattern(spark):
    names = ["a.htm", "A.HTM", ".htm", "htm", "a.b.pdf", "a.tar.gz", "a.p df", "a.", "a.htm\n", "", None, "a.xml.", "d1.jpg", "a.htm b.txt"]
    got = {r["filename"]: r["doc_ext"] for r in co.document_table(spark.createDataFrame([("1", n, None) for n in names], "accession string, filename string, primary_file_num string")).collect()}
    for n in names:
        found = re.search(r"(\.[a-z0-9]+)$", (n or "").lower())
        assert got[n] == (found.group(1) if found else None), n
