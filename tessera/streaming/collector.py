"""The collector: a paged search as a stream of windows, resumable by its checkpoint.

``paged_search_stream`` is a streaming source whose offset is the set of windows
(track, form, month) that are done. A batch is the windows that are due and not done, dealt
to a few tasks (what serves the pages wants few at a time); what a window's pages gave is kept in a month cache, so that a batch
that fails half-way is not fetched again. ``collect`` takes what is due, makes
records, and appends those whose hit is new to a table by month.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..catalog import TRACKS
from ..operators.corpus import records_from_hits
from ..sources.readers import HITS, halves, whole_range
from ..sources.tables import KeyedTable

OLD_TRACK = "tender"


def months(start: str, end: str) -> list[tuple[str, str]]:
    """The months that a range of days touches, clipped to it."""
    if date.fromisoformat(start) > date.fromisoformat(end):
        return []
    return [(max(str(m.start_time.date()), start), min(str(m.end_time.date()), end)) for m in pd.period_range(start, end, freq="M")]


class Window:
    def __init__(self, track: str, form: str, start: str, end: str):
        self.track, self.form, self.start, self.end = track, form, start, end

    @property
    def key(self) -> str:
        return f"{self.track}|{self.form}|{self.start}|{self.end}"

    def is_done(self, done: set[str]) -> bool:
        """By its key; the first track's windows also by the key without a track, as they once were written."""
        return self.key in done or (self.track == OLD_TRACK and self.key.split("|", 1)[1] in done)


class Share(InputPartition):
    """The windows of one task."""

    def __init__(self, windows: list[Window]):
        self.windows = windows


class WindowCache:
    """A file for each window's hits (for each range's, if it is read in halves), in any file system that Arrow reaches; a file is there whole or not at all."""

    def __init__(self, root: str):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(root)

    def _at(self, window: Window, start: str | None, end: str | None) -> str:
        part = "" if (start or window.start, end or window.end) == (window.start, window.end) else f"|{start}|{end}"
        name = "".join(c if c.isalnum() or c in "-." else "_" for c in window.key + part)
        return f"{self.root}/{window.start[:7]}/{name}.json"

    def get(self, window: Window, start: str | None = None, end: str | None = None) -> list[dict] | None:
        from pyarrow import fs

        path = self._at(window, start, end)
        if self.fs.get_file_info(path).type != fs.FileType.File:
            return None
        with self.fs.open_input_stream(path) as stream:
            return json.loads(stream.read().decode())

    def put(self, window: Window, hits: list[dict], start: str | None = None, end: str | None = None) -> None:
        self.write(self._at(window, start, end), hits)

    def write(self, path: str, content) -> None:
        import uuid

        self.fs.create_dir(path.rpartition("/")[0], recursive=True)
        part = f"{path}.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(part) as stream:
            stream.write(json.dumps(content, default=str).encode())
        self.fs.move(part, path)


class SearchStream(DataSource):
    """Options: start, end, tracks (JSON: name to forms), cache (a shared folder), fetcher and page_size as in ``paged_search``; tasks: at most so many fetch at a time (16); fetcher_args: more arguments (JSON) for it; done: keys (JSON) of windows that another run has done."""

    @classmethod
    def name(cls) -> str:
        return "paged_search_stream"

    def schema(self) -> str:
        return "track string, form string, window_start string, window_end string, hit string"

    def streamReader(self, schema) -> SearchStreamReader:  # noqa: N802
        return SearchStreamReader(dict(self.options))


class SearchStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.options = {k.lower(): v for k, v in options.items()}

    def _windows(self) -> list[Window]:
        tracks: dict[str, list[str]] = json.loads(self.options["tracks"])
        return [Window(t, f, a, b) for t, forms in tracks.items() for f in forms for a, b in months(self.options["start"], self.options["end"])]

    def initialOffset(self) -> dict:  # noqa: N802
        return {"done": sorted(json.loads(self.options.get("done", "[]")))}

    def latestOffset(self) -> dict:  # noqa: N802
        """What was done before, and all windows that are due now."""
        return {"done": sorted({w.key for w in self._windows()} | set(done_windows(self.options["cache"])))}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        done, due = set(start["done"]), set(end["done"])
        new = [w for w in self._windows() if w.key in due and not w.is_done(done)]
        tasks = max(1, min(int(self.options.get("tasks", "16")), len(new)))
        return [Share(new[k::tasks]) for k in range(tasks)]

    def read(self, partition: Share) -> Iterator[tuple]:
        cache = WindowCache(self.options["cache"])
        for w in partition.windows:
            for hit in self._hits(cache, w, w.start, w.end):
                yield w.track, w.form, w.start, w.end, json.dumps(hit)

    def _hits(self, cache: WindowCache, window: Window, start: str, end: str) -> Iterator[dict]:
        """The hits of a range of a window's days, cached or fetched; where a search has too many, those of the halves."""
        hits = cache.get(window, start, end)
        if hits is None:
            hits = whole_range(self.options, window.form, start, end)
            if hits is not None:
                cache.put(window, hits, start, end)
        if hits is None:
            for a, b in halves(window.form, start, end):
                yield from self._hits(cache, window, a, b)
        else:
            yield from hits

    def commit(self, end: dict) -> None:
        """The windows that a batch has delivered, where other tools see them. (The engine commits a batch when it plans the next one, so ``collect`` does it for the last.)"""
        cache = WindowCache(self.options["cache"])
        cache.write(f"{cache.root}/done_windows.json", end)


def done_windows(cache: str) -> list[str]:
    """The keys that the last commit wrote."""
    from pyarrow import fs

    at = WindowCache(cache)
    path = f"{at.root}/done_windows.json"
    if at.fs.get_file_info(path).type != fs.FileType.File:
        return []
    with at.fs.open_input_stream(path) as stream:
        return json.loads(stream.read().decode())["done"]


def records_of(hits: DataFrame, tracks: dict[str, Sequence]) -> DataFrame:
    """Records of the stream's hits, with their track, its event types and the window they came from."""
    types = F.create_map(*[x for t, (kinds, _) in tracks.items() for x in (F.lit(t), F.array(*map(F.lit, kinds)))])
    parsed = hits.select("track", "window_start", F.from_json("hit", HITS).alias("h")).where("h._id is not null")
    named = parsed.select("h.*", F.col("track").alias("collection_track"), types[F.col("track")].alias("mvp_event_types"), "window_start")
    return records_from_hits(named, keep=["collection_track", "mvp_event_types", "window_start"])


def collect(spark: SparkSession, root: str, start: str, end: str, fetcher: str, tracks: dict[str, tuple] | None = None, page_size: int = 100, fetcher_args: dict | None = None) -> DataFrame:
    """One run of the collector under ``root`` (a shared folder): fetch what is due and not done, append new records, return all.

    A hit that several windows find is one record, of the first window in order of
    time and track. The table is by month of the window: a batch looks for known
    hits only in the months that it touches, besides the hits' own file dates.
    """
    tracks = tracks or TRACKS
    spark.dataSource.register(SearchStream)
    table = KeyedTable(spark, f"{root}/records", ["hit_id"], part=F.coalesce(F.date_format("file_date", "yyyy-MM"), F.lit("none")))
    options = {"start": start, "end": end, "tracks": json.dumps({t: list(v[1]) for t, v in tracks.items()}), "fetcher": fetcher, "fetcher_args": json.dumps(fetcher_args or {}), "cache": f"{root}/cache", "page_size": str(page_size)}
    stream = spark.readStream.format("paged_search_stream").options(**options).load()

    def append(batch: DataFrame, number: int) -> None:
        order = F.struct("window_start", F.coalesce(*[F.when(F.col("collection_track") == t, F.lit(k)) for k, t in enumerate(tracks)]))
        found = records_of(batch, tracks)
        columns = [c for c in found.columns if c != "hit_id"]
        first = found.groupBy("hit_id").agg(F.min_by(F.struct(*columns), order).alias("r")).select("hit_id", "r.*")
        table.append_missing(first)

    stream.writeStream.foreachBatch(append).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    reader = SearchStreamReader(options)
    reader.commit(reader.latestOffset())
    return table.read().drop("part")
