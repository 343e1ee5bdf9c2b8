"""The op queries with an oracle agree with DuckDB, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from tessera.llm import queries

SF = "/root/testdata/sf0.001"


def shown(df) -> list[str]:
    text = df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None)
    show = lambda v: "NULL" if v is None else f"{v:.9g}" if isinstance(v, float) and v != int(v) else str(int(v)) if isinstance(v, float) else str(v)
    return sorted("|".join(map(show, r)) for r in text.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(queries.oracles()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, expected = queries.queries()[name](spark, SF).toPandas(), con.sql(queries.oracles()[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert shown(got) == shown(expected)
