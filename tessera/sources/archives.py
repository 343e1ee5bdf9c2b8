"""ZIP archives by member: the central directory is read first, and members are dealt to partitions.

``spark.read.format('zip_members')`` with the options path (a file or a folder, in any file
system that Arrow reaches), suffix (only members that end so) and megabytes (of
compressed members a partition, 64). So an archive of 100 GB is many tasks, each of
which reads the ranges of its own members and nothing else. Columns: archive, member,
bytes, content (null where a member can't be read) and error.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


#: Bytes of an empty archive, the end of a central directory.
LEAST = 22


class Members(InputPartition):
    """Some members of an archive; an error stands for an archive that can't be read."""

    def __init__(self, archive: str, names: list[str], error: str | None = None):
        self.archive, self.names, self.error = archive, names, error


class ZipSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return "archive string, member string, bytes long, content binary, error string"

    def reader(self, schema) -> ZipReader:
        return ZipReader(dict(self.options))


class ZipReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = {k.lower(): v for k, v in options.items()}

    def _files(self):
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(self.options["path"])
        info = files.get_file_info(base)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.options["path"])
        found = [info] if info.is_file else [i for i in files.get_file_info(fs.FileSelector(base, recursive=True)) if i.is_file and i.path.lower().endswith(".zip")]
        return files, sorted(i.path for i in found)

    def partitions(self) -> list[Members]:
        """The directories alone are read here: some 100 bytes a member."""
        files, paths = self._files()
        most, suffix, out = float(self.options.get("megabytes", "64")) * 1e6, self.options.get("suffix", ""), []
        for path in paths:
            try:
                if files.get_file_info(path).size < LEAST:
                    raise zipfile.BadZipFile("File is not a zip file")
                with files.open_input_file(path) as raw, zipfile.ZipFile(raw) as archive:
                    infos = sorted((i for i in archive.infolist() if not i.is_dir() and i.filename.endswith(suffix)), key=lambda i: i.header_offset)
            except zipfile.BadZipFile as error:
                out.append(Members(path, [], str(error)))
                continue
            names: list[str] = []
            size = 0
            for info in infos:
                if names and size + info.compress_size > most:
                    out.append(Members(path, names))
                    names, size = [], 0
                names.append(info.filename)
                size += info.compress_size
            if names:
                out.append(Members(path, names))
        return out or [Members("", [])]

    def read(self, partition: Members) -> Iterator[tuple]:
        if partition.error:
            yield partition.archive, None, None, None, partition.error
        if not partition.names:
            return
        from pyarrow import fs

        files, _ = fs.FileSystem.from_uri(self.options["path"])
        with files.open_input_file(partition.archive) as raw, zipfile.ZipFile(raw) as archive:
            for name in partition.names:
                try:
                    content = archive.read(name)
                    yield partition.archive, name, len(content), content, None
                except (zipfile.BadZipFile, NotImplementedError, RuntimeError) as error:  # damaged, an unknown compression, encrypted
                    yield partition.archive, name, None, None, str(error)


def zip_members(spark: SparkSession, path: str, suffix: str = "", megabytes: float = 64) -> DataFrame:
    spark.dataSource.register(ZipSource)
    return spark.read.format("zip_members").options(path=path, suffix=suffix, megabytes=str(megabytes)).load()


def read_json_members(spark: SparkSession, path: str, schema: str, megabytes: float = 64) -> DataFrame:
    """(archive, member, document, error) of the JSON members; one that can't be read or has no text is a row with its error."""
    rows = zip_members(spark, path, ".json", megabytes)
    text = F.expr("try_validate_utf8(cast(content as string))")
    parsed = rows.select("archive", "member", "error", F.from_json(text, schema).alias("document"), (F.col("content").isNotNull() & text.isNull()).alias("undecodable"))
    empty = F.coalesce(F.length("document.text"), F.lit(0)) == 0 if "text" in schema else F.col("document").isNull()
    return parsed.select("archive", "member", "document", F.coalesce("error", F.when(F.col("undecodable"), "not UTF-8").when(empty, "empty text")).alias("error"))


def write_archives(df: DataFrame, path: str, member: str, content: str) -> DataFrame:
    """Rows as members of ZIP archives, one archive a partition of ``df``; the archives' names and numbers of members."""
    rows = df.select(F.col(member).cast("string").alias("member"), F.col(content).alias("content"))

    def write(batches):
        import uuid

        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        files, base = fs.FileSystem.from_uri(path)
        files.create_dir(base, recursive=True)
        name = f"{base}/part-{TaskContext.get().partitionId():05d}.zip"
        part, n = f"{name}.{uuid.uuid4().hex}", 0
        with files.open_output_stream(part) as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as archive:
            for batch in batches:
                for m, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    archive.writestr(m, c if c is not None else "")
                    n += 1
        files.move(part, name)  # whole or not at all; a second attempt puts the same in its place
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], names=["archive", "members"])

    return rows.mapInArrow(write, "archive string, members long")
