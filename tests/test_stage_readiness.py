"""The stages' tables come from documents and events that are made once."""

from __future__ import annotations

from tessera.plans import table_queries

SF = "/root/testdata/sf0.001"


def test_documents_are_made_once(spark):
    files = table_queries.stage_readiness(spark, SF).inputFiles()
    assert files and not any("lineitem" in f for f in files)
