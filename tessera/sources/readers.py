"""Readers: search hits, CSV, JSON lines, archives, texts, tables with fallbacks, and work lists."""

from __future__ import annotations

import importlib
import io
import json
import zipfile
from collections.abc import Callable, Iterator, Sequence
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..catalog import TRACKS

HITS = (
    "_id string, _source struct<adsh:string, form:string, root_forms:array<string>, file_type:string, file_description:string, file_date:string, sequence:string, "
    "ciks:array<string>, display_names:array<string>, file_num:array<string>, biz_states:array<string>, inc_states:array<string>, sics:array<string>, xsl:string>"
)


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HITS).json(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, a byte order mark on the first name dropped."""
    df = spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).option("escape", '"').csv(path)
    return df.withColumnsRenamed({c: c.lstrip("﻿") for c in df.columns if c.startswith("﻿")})


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_archive(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON members of ZIP archives: (archive, member, document, error); an unreadable member is a row with its error."""

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                out = []
                try:
                    with zipfile.ZipFile(io.BytesIO(row.content)) as archive:
                        for name in sorted(archive.namelist()):
                            if name.endswith(".json"):
                                try:
                                    out.append((row.path, name, archive.read(name).decode("utf-8"), None))
                                except (zipfile.BadZipFile, UnicodeDecodeError) as error:
                                    out.append((row.path, name, None, str(error)))
                except zipfile.BadZipFile as error:
                    out.append((row.path, None, None, str(error)))
                yield pd.DataFrame(out, columns=["archive", "member", "content", "error"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInPandas(members, "archive string, member string, content string, error string")
    parsed = rows.withColumn("document", F.from_json("content", schema))
    empty = F.coalesce(F.length("document.text"), F.lit(0)) == 0 if "text" in schema else F.col("document").isNull()
    return parsed.select("archive", "member", "document", F.coalesce("error", F.when(empty, F.lit("empty text"))).alias("error"))


def decoded(content: Column) -> Column:
    """Bytes as text; undecodable ones are replaced."""
    text = content.cast("string")
    return F.coalesce(F.try_validate_utf8(text), F.make_valid_utf8(text))


def looks_like_html(text: Column, sniff: int = 1200) -> Column:
    """By what a text begins with."""
    head = F.lower(F.substring(text, 1, sniff))
    return F.contains(head, F.lit("<html")) | F.ltrim(head).startswith("<!doctype")


def read_texts(spark: SparkSession, path: str, sniff: int = 1200) -> DataFrame:
    """(path, text, is_html) of whole files; undecodable bytes are replaced."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", decoded(F.col("content")).alias("text")).withColumn("is_html", looks_like_html(F.col("text"), sniff))


def first_that_exists(spark: SparkSession, *candidates: tuple[str, Callable[[str], DataFrame]]) -> DataFrame:
    """The first of (path, reader) whose path is there."""
    for path, reader in candidates:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return reader(path)
    raise FileNotFoundError(f"none of {', '.join(p for p, _ in candidates)}")


def month_windows(ranges: DataFrame, start: str, end: str) -> DataFrame:
    """A row for each month that a range touches, clipped to the range."""
    months = ranges.withColumn("__m", F.explode(F.sequence(F.trunc(start, "MM"), F.col(end), F.expr("interval 1 month"))))
    return months.withColumn("window_start", F.greatest("__m", start)).withColumn("window_end", F.least(F.last_day("__m"), F.col(end))).drop("__m")


def work_list(spark: SparkSession, start: str, end: str, done: DataFrame | None = None, tracks: Sequence[str] | None = None) -> DataFrame:
    """(track, form, window) still to be fetched; done: keys ``track|form|start|end``, or without the track for the first one."""
    rows = [(t, f) for t in (tracks or TRACKS) for f in TRACKS[t][1]]
    ranges = spark.createDataFrame(rows, "track string, form string").withColumn("s", F.lit(start).cast("date")).withColumn("e", F.lit(end).cast("date"))
    out = month_windows(ranges, "s", "e").drop("s", "e")
    old_key = F.concat_ws("|", "form", "window_start", "window_end")
    out = out.withColumn("key", F.concat_ws("|", "track", old_key)).withColumn("old_key", F.when(F.col("track") == "tender", old_key))
    if done is not None:
        out = out.join(done.select("key"), "key", "left_anti").join(done.select(F.col("key").alias("old_key")), "old_key", "left_anti")
    return out.drop("old_key")


class SearchSource(DataSource):
    """A paged search as a table: ``spark.read.format('paged_search')``.

    Options: start, end, forms (separated by commas), page_size, and fetcher, the
    ``module:function`` that returns one page: fetcher(form, start, end, offset,
    size) -> (total, list of JSON hits), with fetcher_args (JSON) as further arguments. The
    windows (form, month) are dealt to at most ``tasks`` (16) tasks; one of LIMIT hits or more,
    which a search does not list, is read in halves, down to a day.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_search"

    def schema(self) -> str:
        return "form string, window_start string, window_end string, hit_id string, hit string"

    def reader(self, schema) -> SearchReader:
        return SearchReader(dict(self.options))


class SearchPart(InputPartition):
    """The windows (form, start, end) of one task."""

    def __init__(self, windows: list[tuple[str, str, str]]):
        self.windows = windows


class SearchReader(DataSourceReader):
    LIMIT = 10_000

    def __init__(self, options: dict[str, str]):
        self.options = {k.lower(): v for k, v in options.items()}

    def partitions(self) -> list[SearchPart]:
        out = []
        for form in self.options["forms"].split(","):
            for month in pd.period_range(self.options["start"], self.options["end"], freq="M"):
                first, last = max(str(month.start_time.date()), self.options["start"]), min(str(month.end_time.date()), self.options["end"])
                out.append((form, first, last))
        tasks = max(1, min(int(self.options.get("tasks", "16")), len(out)))
        return [SearchPart(out[k::tasks]) for k in range(tasks)]

    def read(self, partition: SearchPart) -> Iterator[tuple]:
        for window in partition.windows:
            for hit in self._hits(window, *window[1:]):
                yield *window, hit.get("_id"), json.dumps(hit)

    def _hits(self, window: tuple[str, str, str], start: str, end: str) -> Iterator[dict]:
        """The hits of a range of a window's days; where a search has too many, those of the halves."""
        hits = whole_range(self.options, window[0], start, end)
        if hits is None:
            for a, b in halves(window[0], start, end):
                yield from self._hits(window, a, b)
        else:
            yield from hits


def halves(form: str, start: str, end: str) -> list[tuple[str, str]]:
    """A range of days as two."""
    first, last = date.fromisoformat(start), date.fromisoformat(end)
    if first >= last:
        raise ValueError(f"{form} on {start} has {SearchReader.LIMIT} hits or more; a search by day cannot list them")
    middle = first + (last - first) // 2
    return [(start, str(middle)), (str(middle + timedelta(days=1)), end)]


def whole_range(options: dict[str, str], form: str, start: str, end: str) -> list[dict] | None:
    """Every page of a search, complete or not at all; None if it has more hits than a search lists."""
    module, _, name = options["fetcher"].partition(":")
    fetch, size = getattr(importlib.import_module(module), name), int(options.get("page_size", "100"))
    more, hits = json.loads(options.get("fetcher_args", "{}")), []
    while True:
        total, page = fetch(form, start, end, len(hits), size, **more)
        if total >= SearchReader.LIMIT:
            return None
        hits += page
        if len(hits) >= total:
            return hits
        if not page:
            raise ValueError(f"{form} {start} to {end} is incomplete: {len(hits)} of {total}")
