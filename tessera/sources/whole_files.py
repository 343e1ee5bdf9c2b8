"""Texts as files of their own, written and read by the tasks.

Spark's writers move every file of a job in the driver, and its readers list every file
there, so that a file a text costs the driver as much as there are texts. Here each
task writes its texts and tells where they are; tasks that get such rows read them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .readers import decoded, looks_like_html

#: Files a folder, and a batch of texts that is held at once.
FOLDER = 1000
HELD = 64


def write_files(df: DataFrame, path: str, name: str, text: str) -> DataFrame:
    """(name, file) of each text, written as UTF-8 to a file of its own under ``path``; a null text has no file.

    An attempt of a task has folders of its own, so neither equal names nor a second attempt meet.
    """
    rows = df.select(F.col(name), F.col(text).cast("binary").alias("__content"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(path)
        mine, n = f"{base}/{uuid.uuid4().hex}", 0
        for batch in batches:
            places: list[str | None] = []
            for content in batch.column(1):
                if not content.is_valid:
                    places.append(None)
                    continue
                if n % FOLDER == 0:
                    files.create_dir(f"{mine}/{n // FOLDER}", recursive=True)
                places.append(f"{mine}/{n // FOLDER}/{n}")
                n += 1
                with files.open_output_stream(places[-1]) as out:
                    out.write(content.as_buffer())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(places, pa.string())], names=[name, "file"])

    return rows.mapInArrow(write, f"{name} {dict(df.dtypes)[name]}, file string")


def read_files(listed: DataFrame, path: str, name: str, sniff: int = 1200) -> DataFrame:
    """(name, text, is_html) of the whole files that ``write_files`` told; undecodable bytes are replaced, no file is a null text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, _ = fs.FileSystem.from_uri(path)

        def whole(place: str | None) -> bytes | None:
            if place is None:
                return None
            with files.open_input_stream(place) as source:
                return source.read()

        for batch in batches:
            for k in range(0, batch.num_rows, HELD):
                part = batch.slice(k, HELD)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([whole(p) for p in part.column(1).to_pylist()], pa.binary())], names=[name, "content"])

    rows = listed.select(name, "file").mapInArrow(read, f"{name} {dict(listed.dtypes)[name]}, content binary")
    return rows.select(name, decoded(F.col("content")).alias("text")).withColumn("is_html", looks_like_html(F.col("text"), sniff))
