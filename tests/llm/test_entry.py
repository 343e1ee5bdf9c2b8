"""The op queries and the pipeline, whole."""

from __future__ import annotations

import corpus_pipeline
from tessera.llm import queries

SF = "/root/testdata/sf0.001"


def test_names():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 14)]
    assert set(queries.oracles()) <= set(names)


def test_queries_run_on_empty_tables(spark, tmp_path):
    for table in ("documents", "pages", "benchmark", "labels", "conversations"):
        spark.read.parquet(f"{SF}/{table}.parquet").limit(0).write.parquet(str(tmp_path / f"{table}.parquet"))
    for name, query in queries.queries().items():
        assert query(spark, str(tmp_path)).count() == 0, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
