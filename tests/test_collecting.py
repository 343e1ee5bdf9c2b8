"""The collector over two runs, keyed tables and databases."""

from __future__ import annotations

import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.sources.database import Database, SqliteFile, resolve_dsn
from tessera.sources.readers import SearchSource
from tessera.sources.tables import PART, KeyedTable
from tessera.streaming import collector as co

TRACKS = {"tender": (("tender_offer",), ("SC TO-T", "SC TO-I")), "other": (("merger", "exchange_offer"), ("S-4",))}


def served(form: str, start: str, end: str, offset: int, size: int, root: str):
    """Pages from a file of hits; each call leaves a line in a log."""
    root = Path(root)
    with (root / "log").open("a") as log:
        log.write(f"{form}|{start}|{end}|{offset}\n")
    hits = [h for h in json.loads((root / "hits").read_text()) if form in h["_source"]["root_forms"] and start <= h["_source"]["file_date"] <= end]
    if (root / "broken").exists() and form == (root / "broken").read_text():
        return len(hits) + 1, []
    return len(hits), hits[offset : offset + size]


def hit(k: int, form: str, day: str, roots: list[str] | None = None) -> dict:
    return {"_id": f"{k}:f{k}.htm", "_source": {"adsh": f"{k:010d}-20-000001", "form": form, "root_forms": roots or [form], "file_type": form, "file_date": day, "sequence": "1", "ciks": ["0000000001"], "display_names": ["Works Corp (WRK) (CIK 0000000001)"], "file_num": ["005-1"]}}


def test_collector_resumes(spark, tmp_path):
    hits = [hit(k, "SC TO-T", f"2020-0{1 + k % 3}-1{k % 9}") for k in range(25)] + [hit(100, "S-4", "2020-02-03"), hit(101, "S-4", "2020-02-04", ["S-4", "SC TO-I"])]
    (tmp_path / "hits").write_text(json.dumps(hits))
    root, log = f"file://{tmp_path}/run", tmp_path / "log"

    def run(end: str):
        return co.collect(spark, root, "2020-01-05", end, "tests.test_collecting:served", TRACKS, page_size=4, fetcher_args={"root": str(tmp_path)})

    (tmp_path / "broken").write_text("S-4")
    with pytest.raises(Exception, match="incomplete"):
        run("2020-02-29")
    good = {line.rsplit("|", 1)[0] for line in log.read_text().split("\n") if line.startswith("SC")}
    assert len(good) == 4
    (tmp_path / "broken").unlink()
    log.write_text("")
    first = {r["hit_id"]: r for r in run("2020-02-29").collect()}
    inside = [h for h in hits if "2020-01-05" <= h["_source"]["file_date"] <= "2020-02-29"]
    assert set(first) == {h["_id"] for h in inside} and len(first) == len(inside)
    assert {line.split("|")[0] for line in log.read_text().split()} <= {"S-4"} or "SC" not in log.read_text()  # the others came from the cache
    assert first["101:f101.htm"]["collection_track"] == "tender" and first["100:f100.htm"]["mvp_event_types"] == ["merger", "exchange_offer"]
    assert first["101:f101.htm"]["window_start"] == "2020-02-01" and first["100:f100.htm"]["primary_cik"] == "0000000001"
    log.write_text("")
    assert run("2020-02-29").count() == len(inside) and log.read_text() == ""  # nothing is due
    (tmp_path / "hits").write_text(json.dumps([*hits, hit(200, "SC TO-I", "2020-03-03"), hit(201, "SC TO-I", "2020-01-20")]))
    again = {r["hit_id"] for r in run("2020-03-31").collect()}
    assert again == {h["_id"] for h in hits if h["_source"]["file_date"] >= "2020-01-05"} | {"200:f200.htm"}
    assert {line.split("|")[1] for line in log.read_text().split("\n") if line} == {"2020-03-01"}  # done windows aren't asked for again
    assert len(co.done_windows(f"{root}/cache")) == 9


def test_months_and_old_keys():
    assert co.months("2020-01-31", "2020-03-01") == [("2020-01-31", "2020-01-31"), ("2020-02-01", "2020-02-29"), ("2020-03-01", "2020-03-01")]
    assert co.months("2020-02-01", "2020-01-01") == []
    window = co.Window("tender", "S-4", "a", "b")
    assert window.is_done({"tender|S-4|a|b"}) and window.is_done({"S-4|a|b"}) and not co.Window("other", "S-4", "a", "b").is_done({"S-4|a|b"})


def files(path: Path) -> dict[str, int]:
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_keyed_table_touches_few_parts(spark, tmp_path):
    rows = [(k, f"n{k}", k * 1.0, "seg") for k in range(1000)] + [(None, "none", 0.0, "seg")]
    df = spark.createDataFrame(rows, "k long, name string, balance double, segment string")
    t = KeyedTable(spark, f"file://{tmp_path}/t", ["k"], part=F.coalesce(F.call_function("div", F.col("k"), F.lit(50)), F.lit(-1)))
    t.write(df)
    before = files(tmp_path / "t")
    change = spark.createDataFrame([(101, "new", None, "x"), (102, "new", 5.0, "x"), (None, "null", None, "x"), (2000, "added", 1.0, "y")], df.schema)
    assert sorted(t.upsert(change, keep=["segment"], fill=["balance"])) == ["-1", "2", "40"]
    after = files(tmp_path / "t")
    assert {n.split("/")[0] for n, _ in set(before.items()) - set(after.items())} == {"part=2", "part=-1"}
    assert {n.split("/")[0] for n in set(after) - set(before)} == {"part=2", "part=-1", "part=40"}
    got = {r["k"]: (r["name"], r["balance"], r["segment"]) for r in t.read().collect()}
    expected = {k: (n, b, s) for k, n, b, s in rows} | {101: ("new", 101.0, "seg"), 102: ("new", 5.0, "seg"), None: ("null", 0.0, "seg"), 2000: ("added", 1.0, "y")}
    assert got == expected and t.read().count() == len(expected)
    filters = t.read(["2"])._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert "part#" in filters and "cast" not in filters
    named = KeyedTable(spark, f"file://{tmp_path}/u", ["k"], part=F.format_string("%03d", "k"))
    named.write(df.where("k < 12"))
    named.append_missing(df.where("k between 5 and 14"))
    assert sorted(r["part"] for r in named.read().collect()) == [f"{k:03d}" for k in range(15)]


def test_appends_read_what_they_touch(spark, tmp_path):
    """The rows read for a batch stay the same while the table grows."""
    t = KeyedTable(spark, f"file://{tmp_path}/t", ["k"], part=F.call_function("div", F.col("k"), F.lit(100)))
    read = []
    for step in range(6):
        batch = spark.range(step * 100 - 20 if step else 0, step * 100 + 80).select(F.col("id").alias("k"), F.lit(step).alias("step"))
        batch = batch.union(batch.limit(10))
        if step:
            read.append(t.read(t.touched(t.placed(batch))).count())
        t.append_missing(batch)
        t.append_missing(batch)  # replayed
    assert t.read().count() == 580 and t.read().select("k").distinct().count() == 580
    assert max(read) <= 100


def test_dsn():
    assert resolve_dsn(["A", "B"], "c", {"B": "b"}) == "b" and resolve_dsn(["A"], "c", {"A": ""}) == "c"
    with pytest.raises(LookupError):
        resolve_dsn(["A"], env={})
    db = Database.of("postgresql://me:p%40ss@db.example:5433/things?sslmode=require")
    assert db.url == "jdbc:postgresql://db.example:5433/things" and db.properties == {"driver": "org.postgresql.Driver", "sslmode": "require", "user": "me", "password": "p@ss"}
    assert "p@ss" not in repr(db)
    with pytest.raises(ValueError, match="not a database"):
        Database.of("http://x/")


def test_database(spark, tmp_path):
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", str(tmp_path / "derby.log"))
    db = Database.of(f"jdbc:derby:{tmp_path}/db;create=true")
    df = spark.range(1000).select(F.col("id").alias("k"), F.concat(F.lit("n"), (F.col("id") % 7).cast("string")).alias("name"), (F.col("id") * 0.5).alias("v"))
    db.write(df, "t", "overwrite", types="name VARCHAR(20)")
    read = db.read(spark, "t", "k", parts=4)
    assert read.rdd.getNumPartitions() == 4 and read.count() == 1000
    few = read.where("name = 'n3' and k < 100").select("k")
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "EqualTo(NAME,n3)" in plan.replace("*", "").replace("name", "NAME") and "LessThan" in plan
    assert sorted(r[0] for r in few.collect()) == [k for k in range(100) if k % 7 == 3]
    db.write(spark.createDataFrame([(5000, "x", 1.0)], df.schema), "t")
    assert db.read(spark, "t").count() == 1001
    db.write(df.limit(0), "empty", "overwrite")
    assert db.read(spark, "empty", "k", parts=4).count() == 0
    assert PART == "part"


def test_windows_of_too_many_hits_are_halved(spark, tmp_path):
    """10,500 hits of a month, more than a search lists, by both readers; a day of as many is refused."""
    hits = [hit(k, "S-4", f"2020-03-{1 + k % 30:02d}") for k in range(10_500)]
    (tmp_path / "hits").write_text(json.dumps(hits))
    args, root, log = {"root": str(tmp_path)}, f"file://{tmp_path}/run", tmp_path / "log"
    spark.dataSource.register(SearchSource)

    def batch(start: str):
        options = {"start": start, "end": "2020-03-31", "forms": "S-4", "page_size": "6000", "fetcher": "tests.test_collecting:served", "fetcher_args": json.dumps(args)}
        return spark.read.format("paged_search").options(**options).load()

    got = batch("2020-03-01").select("window_start", "window_end", "hit_id").collect()
    assert {tuple(r)[:2] for r in got} == {("2020-03-01", "2020-03-31")} and sorted(r.hit_id for r in got) == sorted(h["_id"] for h in hits)
    log.write_text("")
    run = lambda end: co.collect(spark, root, "2020-03-01", end, "tests.test_collecting:served", {"other": (("merger",), ("S-4",))}, page_size=6000, fetcher_args=args)
    records = run("2020-03-31").cache()
    assert records.count() == records.select("hit_id").distinct().count() == 10_500 and [r[0] for r in records.select("window_start").distinct().collect()] == ["2020-03-01"]
    assert len(log.read_text().split("\n")) > 2 and len(co.done_windows(f"{root}/cache")) == 1
    (tmp_path / "hits").write_text(json.dumps([hit(k, "S-4", "2020-03-07") for k in range(10_000)]))
    with pytest.raises(Exception, match="2020-03-07 has 10000 hits or more"):
        batch("2020-03-07").count()


def test_database_file_serves_several_processes(spark, tmp_path):
    """Another process holds the file open, as an executor does: an embedded Java database refuses the next one."""
    db = SqliteFile(str(tmp_path / "d b.sqlite"))
    df = spark.range(1000).select(F.when(F.col("id") > 0, F.col("id")).alias("k"), F.concat(F.lit("n"), (F.col("id") % 7).cast("string")).alias('na"me'), F.when(F.col("id") % 3 > 0, F.col("id") * 0.5).alias("v"))
    db.write(df, "t", "overwrite", parts=3, batch=70)
    code = f"import sqlite3,sys; c = sqlite3.connect({db.path!r}); print(c.execute('select count(*) from t').fetchone()[0], flush=True); sys.stdin.read()"
    with subprocess.Popen([sys.executable, "-c", code], stdin=subprocess.PIPE, stdout=subprocess.PIPE, text=True) as other:
        assert other.stdout.readline() == "1000\n"
        db.index("t", "k")
        schema = 'v double, k long, `na"me` string'
        read = db.read(spark, "t", schema, "k", parts=4, fetch=33)
        assert read.rdd.getNumPartitions() == 4
        assert sorted(map(tuple, read.collect()), key=str) == sorted(map(tuple, df.select("v", "k", 'na"me').collect()), key=str)
        db.write(df.limit(10), "t")
        other.stdin.close()
    few = db.read(spark, "t", schema, "k", parts=4, where="\"na\"\"me\" = 'n3' or k < 20").select("k")
    assert sorted(r[0] for r in few.collect()) == sorted([k for k in range(1, 1000) if k % 7 == 3 or k < 20] + list(range(1, 10)))
    db.write(df.limit(0), "empty", "overwrite")
    assert db.read(spark, "empty", schema, "k", parts=4).count() == 0
    with pytest.raises(Exception, match="NaN"):
        db.write(df.withColumn("v", F.lit(float("nan"))), "nan", "overwrite")
    with pytest.raises(ValueError, match="no column type"):
        db.write(df.withColumn("v", F.current_date()), "day", "overwrite")
