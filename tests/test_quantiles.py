"""Order statistics against sorted lists."""

from __future__ import annotations

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import quantiles as qu


def groups() -> dict:
    r = random.Random(8)
    return {
        "a": [r.random() for _ in range(700)], "same": [3.0] * 50, "one": [7.0], "two": [1.0, 2.0], None: [r.gauss(0, 1e6) for _ in range(333)], "skew": [2.0**k for k in range(-300, 300, 3)] + [0.0] * 11,
        "odd": [-1e308, 1e308, 5e-324, 0.0, -5e-324, 1.0], "ties": [float(r.randint(0, 3)) for _ in range(801)], "ends": [float("-inf"), 1.0, 2.0, float("inf")], "nulls": [None, None], "mixed": [None, 4.0, None, 9.0],
    }


def test_described(spark):
    g = groups()
    df = spark.createDataFrame([(k, v) for k, vs in g.items() for v in vs], "k string, v double")
    got = {r["k"]: r for r in qu.described(df, "v", "k").collect()}
    assert set(got) == set(g)
    for k, vs in g.items():
        there, r = sorted(v for v in vs if v is not None), got[k]
        assert r["n"] == len(there)
        if not there:
            assert r["p50"] is None and r["max"] is None
        elif k not in ("ends", "odd"):
            for name, q in (("p25", 25), ("p50", 50), ("p75", 75)):
                assert r[name] == pytest.approx(np.percentile(there, q), rel=1e-12)
        else:
            assert (r["min"], r["max"]) == (there[0], there[-1])
    one = qu.described(df.where("k in ('a', 'mixed', 'nulls')"), "v").first()
    assert one["n"] == 702
    none = qu.described(df.where("false"), "v").first()
    assert none["n"] == 0 and none["p25"] is None


def test_medians_of_whole_numbers(spark):
    r = random.Random(9)
    g = {k: [r.choice([r.randint(-(2**62), 2**62), r.randint(0, 9)]) for _ in range(n)] for k, n in (("a", 200), ("b", 201), ("c", 1), ("d", 2))}
    df = spark.createDataFrame([(k, v) for k, vs in g.items() for v in vs] + [("e", None)], "k string, v long")
    got = {r["k"]: r for r in qu.medians(df, "v", "k").collect()}
    for k, vs in g.items():
        assert got[k]["upper_median"] == sorted(vs)[len(vs) // 2] and got[k]["n"] == len(vs)
        assert got[k]["median"] == pytest.approx(statistics.median(vs), rel=1e-12)
    assert got["e"]["n"] == 1 and got["e"]["median"] is None


def test_every_rank(spark):
    values = [random.Random(1).randint(0, 60) for _ in range(41)]
    df = spark.createDataFrame([(v,) for v in values], "v int")
    r = qu.order_statistics(df, "v", [], {f"r{k}": F.lit(k) for k in range(41)}).first()
    assert [r[f"r{k}"] for k in range(41)] == sorted(values)
