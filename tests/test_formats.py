"""ZIP members dealt to tasks, damaged ones included, and manifests of any shape."""

from __future__ import annotations

import zipfile
from pathlib import Path

from pyspark.sql import functions as F

from tessera.operators import stages as st
from tessera.sources import archives as ar


def test_members_are_dealt(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_STORED) as z:
        for k in range(40):
            z.writestr(f"d/{k:02d}.json", '{"text":"' + "x" * 50_000 + str(k) + '"}')
        z.writestr("d/", "")
        z.writestr("note.txt", "not asked for")
        z.writestr("empty.json", '{"text":""}')
        z.writestr("latin.json", b'{"text":"\xe9"}')
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    raw = bytearray((tmp_path / "a.zip").read_bytes())
    raw[raw.find(b"xxxx" * 9) + 1000] ^= 1  # one member's check sum
    (tmp_path / "c.zip").write_bytes(raw)
    rows = ar.read_json_members(spark, f"file://{tmp_path}", "text string", megabytes=0.3)
    assert rows.rdd.getNumPartitions() >= 14
    got = {(r["archive"].rsplit("/", 1)[1], r["member"]): (r["document"] and r["document"]["text"], r["error"]) for r in rows.collect()}
    assert len(got) == 2 * 42 + 1
    assert all(got["a.zip", f"d/{k:02d}.json"] == ("x" * 50_000 + str(k), None) for k in range(40))
    assert got["a.zip", "empty.json"][1] == "empty text" and got["a.zip", "latin.json"][1] == "not UTF-8"
    assert "File is not a zip file" in got["broken.zip", None][1]
    assert [m for (a, m), (_, e) in got.items() if a == "c.zip" and e and "CRC" in e] == ["d/00.json"]
    assert ar.zip_members(spark, f"file://{tmp_path}/a.zip", ".txt").first()["content"] == b"not asked for"


def test_write_archives(spark, tmp_path):
    df = spark.range(20).select((F.col("id").cast("string")).alias("m"), F.when(F.col("id") > 0, F.concat(F.lit("é"), F.col("id").cast("string"))).alias("c"))
    done = ar.write_archives(df.repartition(3), f"file://{tmp_path}/out", "m", "c").collect()
    assert sum(r["members"] for r in done) == 20
    back = {r["member"]: r["content"].decode() for r in ar.zip_members(spark, f"file://{tmp_path}/out").collect()}
    assert back == {str(k): f"é{k}" if k else "" for k in range(20)}


def test_manifests_of_any_shape(spark, tmp_path):
    texts = ['{"stage":"a","status":"ok","ended":"2024-01-01","n":1}', '{"stage":"a","n":2.5,"more":{"x":[1,null]}}', '{"stage":"b","status":"failed"}', "no json", None, "[1]"]
    table = st.manifests(spark.createDataFrame([(t,) for t in texts], "value string"))
    table.write.parquet(str(tmp_path / "m"))
    table = spark.read.parquet(str(tmp_path / "m"))
    assert sorted(map(str, ((r["stage"], r["metric"], r["value"]) for r in st.metric_rows(table).collect()))) == sorted(map(str, [("a", "n", "1"), ("a", "n", "2.5"), ("a", "more", '{"x":[1,null]}')]))
    shapes = {r["stage"]: r["shape"] for r in st.metric_shapes(table.where("stage is not null"), "stage").collect()}
    assert shapes["b"] == "OBJECT<stage: STRING, status: STRING>" and "more: OBJECT<x: ARRAY<BIGINT>>" in shapes["a"] and "n: DECIMAL" in shapes["a"]


def test_archives_grow_in_number(spark, tmp_path, monkeypatch):
    """Not in size: four archives whatever there is made each a quarter of the input."""
    from tessera.plans import format_queries as fq

    made, write = [], ar.write_archives
    monkeypatch.setattr(ar, "write_archives", lambda *a: (made.append(a[1]), write(*a))[1])
    docs = spark.range(4000).selectExpr("id doc_id", "array_join(transform(sequence(1, 8), k -> sha2(concat(id, '-', k), 512)), ' ') text")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    small = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "10k"}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        df = fq.archive_members(spark, str(tmp_path))
    finally:
        for k in small:
            spark.conf.unset(k)
    files = list(Path(made[0].removeprefix("file:")).glob("*.zip"))
    assert len(files) > 4 and df.count() == 4000 and df.select("digest").distinct().count() == 4000
