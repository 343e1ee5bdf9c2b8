"""Every registered query with an oracle agrees with DuckDB, on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pandas as pd
import pytest

from tessera import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]

    def show(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return "NULL"
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        if "float" in type(v).__name__:
            return f"{float(v):.9g}"
        return str(int(v)) if "int" in type(v).__name__ else str(v)

    plain = df.astype(object).where(df.notna(), None)
    return sorted("|".join(map(show, r)) for r in plain.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_oracle(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    expected = duck.sql(registry.oracles()[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracles())))
def test_others_run(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
