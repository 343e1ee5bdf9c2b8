"""Texts as files of their own: no job of Spark's writers or listing of files, whatever their number."""

from __future__ import annotations

from tessera.plans import table_queries
from tessera.sources import whole_files as wf


def test_each_text_has_its_file(spark, tmp_path):
    texts = [(1, "<!DOCTYPE html>é"), (2, ""), (3, None), (4, "a\x01\nb\r\n"), (4, "another of that name"), (None, " <HTML>")]
    path = f"file://{tmp_path}/files"
    listed = wf.write_files(spark.createDataFrame(texts, "id int, text string").repartition(3), path, "id", "text")
    listed.write.parquet(f"{tmp_path}/list")
    got = wf.read_files(spark.read.parquet(f"{tmp_path}/list"), path, "id").collect()
    assert sorted([(r["id"], r["text"]) for r in got], key=str) == sorted(texts, key=str)
    assert {r["text"]: r["is_html"] for r in got} == {"<!DOCTYPE html>é": True, " <HTML>": True, "": False, None: None, "a\x01\nb\r\n": False, "another of that name": False}
    assert sum(p.is_file() for p in (tmp_path / "files").rglob("*")) == 5


def test_folders_hold_few_files(spark, tmp_path, monkeypatch):
    rows = spark.range(2500).selectExpr("id", "cast(id as string) text").coalesce(1)
    path = f"file://{tmp_path}/files"
    listed = wf.write_files(rows, path, "id", "text").collect()
    assert len({r["file"] for r in listed}) == 2500 and max(sum(1 for _ in d.iterdir()) for d in (tmp_path / "files").glob("*/*")) == wf.FOLDER


def test_whole_texts_lists_no_files_in_the_driver(spark, tmp_path):
    spark.createDataFrame([(1, "<html>x\n\x01y"), (2, None), (3, "")], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    df = table_queries.whole_texts(spark, str(tmp_path))
    assert {tuple(r) for r in df.collect()} == {(1, True, 10), (2, None, None), (3, False, 0)}
    assert len(df.inputFiles()) <= 4  # the list's
