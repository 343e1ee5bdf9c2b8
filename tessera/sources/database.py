"""Tables of a relational database, read in parallel ranges of a key: of a server by JDBC, of an SQLite file by its own driver.

An embedded Java database belongs to one process, so it cannot serve the driver and
several executors; an SQLite file in a folder that all of them share can.
"""

from __future__ import annotations

import contextlib
import os
import sqlite3
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from urllib.parse import parse_qsl, unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

DRIVERS = {"postgresql": "org.postgresql.Driver", "mysql": "com.mysql.cj.jdbc.Driver", "derby": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


def resolve_dsn(names: Sequence[str] = ("DATABASE_URL",), default: str | None = None, env: Mapping[str, str] | None = None) -> str:
    """The first of the environment variables that has a value, else the default."""
    env = os.environ if env is None else env
    for name in names:
        if env.get(name):
            return env[name]
    if default is None:
        raise LookupError(f"none of {', '.join(names)} is set")
    return default


@dataclass(frozen=True)
class Database:
    """A JDBC url and its properties."""

    url: str
    properties: dict[str, str] = field(default_factory=dict)

    @classmethod
    def of(cls, dsn: str) -> Database:
        """From ``scheme://user:password@host:port/name?option=value``, or a JDBC url as it is."""
        if dsn.startswith("jdbc:"):
            kind = dsn.split(":")[1]
            return cls(dsn, {"driver": DRIVERS[kind]} if kind in DRIVERS else {})
        at = urlsplit(dsn)
        kind = {"postgres": "postgresql"}.get(at.scheme.split("+")[0], at.scheme.split("+")[0])
        if kind not in DRIVERS or not at.hostname or not at.path.strip("/"):
            raise ValueError(f"not a database: {at.scheme}://{at.hostname or ''}{at.path}")
        host = f"[{at.hostname}]" if ":" in at.hostname else at.hostname
        properties = {"driver": DRIVERS[kind], **dict(parse_qsl(at.query))}
        properties |= {k: unquote(v) for k, v in (("user", at.username), ("password", at.password)) if v is not None}
        return cls(f"jdbc:{kind}://{host}{f':{at.port}' if at.port else ''}{at.path}", properties)

    def __repr__(self) -> str:
        shown = {k: "***" if k == "password" else v for k, v in self.properties.items()}
        return f"Database({self.url!r}, {shown})"

    def read(self, spark: SparkSession, table: str, key: str | None = None, parts: int = 1, fetch: int = 10_000) -> DataFrame:
        """The table; with a numeric or time key in ``parts`` ranges, whose ends the database tells.

        Filters and columns go to the database with each range. Rows without a key are
        read with the first range, those beyond the ends (written meanwhile) with the
        outer ones.
        """
        reader = spark.read.format("jdbc").options(url=self.url, fetchsize=str(fetch), pushDownAggregate="true", **self.properties)
        if key is None or parts < 2:
            return reader.option("dbtable", table).load()
        whole = reader.option("dbtable", table).load()
        name = next((c for c in whole.columns if c.lower() == key.lower()), None)
        if name is None:
            raise ValueError(f"{table} has no column {key}")
        low, high = whole.agg(F.min(name), F.max(name)).first()  # pushed down as one aggregate
        if low is None or low == high:
            return whole
        return reader.options(dbtable=table, partitionColumn=name, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts)).load()

    def write(self, df: DataFrame, table: str, mode: str = "append", types: str | None = None, parts: int = 8, batch: int = 5_000) -> None:
        """Through at most ``parts`` connections; each partition is one transaction. types: column types where the table is made."""
        writer = df.write.format("jdbc").mode(mode).options(url=self.url, dbtable=table, numPartitions=str(parts), batchsize=str(batch), **self.properties)
        (writer.option("createTableColumnTypes", types) if types else writer).save()


SQLITE_TYPES = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "string": "TEXT"}


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


@dataclass(frozen=True)
class SqliteFile:
    """A database file in a folder that the driver and all executors share; wait: seconds for the writer before."""

    path: str
    wait: float = 3600

    @contextlib.contextmanager
    def _open(self) -> Iterator[sqlite3.Connection]:
        with contextlib.closing(sqlite3.connect(self.path, timeout=self.wait, isolation_level=None)) as connection:
            yield connection

    def write(self, df: DataFrame, table: str, mode: str = "append", parts: int = 8, batch: int = 5_000) -> None:
        """Through at most ``parts`` connections; each partition is one transaction, and one writes at a time. As by JDBC, a task that is lost after its commit adds its rows again."""
        kinds = dict(df.dtypes)
        if other := {c: t for c, t in kinds.items() if t not in SQLITE_TYPES}:
            raise ValueError(f"no column type for {other}")
        with self._open() as connection:
            if mode == "overwrite":
                connection.execute(f"DROP TABLE IF EXISTS {quoted(table)}")
            connection.execute(f"CREATE TABLE IF NOT EXISTS {quoted(table)} ({', '.join(f'{quoted(c)} {SQLITE_TYPES[t]}' for c, t in kinds.items())})")
        insert = f"INSERT INTO {quoted(table)} ({', '.join(map(quoted, kinds))}) VALUES ({', '.join('?' * len(kinds))})"

        def put(rows: Iterator[Row]) -> None:
            first = next(rows, None)
            if first is None:
                return
            with self._open() as connection:
                connection.execute("BEGIN IMMEDIATE")
                held = [first]
                for row in rows:
                    held.append(row)
                    if len(held) >= batch:
                        connection.executemany(insert, held)
                        held = []
                connection.executemany(insert, held)
                connection.execute("COMMIT")

        nan = [F.isnan(c) for c, t in kinds.items() if t == "double"]
        if nan:  # the file would hold null
            bad = nan[0]
            for one in nan[1:]:
                bad = bad | one
            df = df.where(F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit("an SQLite file holds no NaN")).cast("boolean")).otherwise(True))
        df.coalesce(parts).foreachPartition(put)

    def read(self, spark: SparkSession, table: str, schema: str, key: str, parts: int = 1, where: str | None = None, fetch: int = 10_000) -> DataFrame:
        """Columns of the table by name and type, in ``parts`` ranges of an integer key, whose ends the file tells.

        ``where``, a condition in SQL, goes to the file with each range. Rows without a
        key are read with the first range, those beyond the ends with the outer ones.
        """
        from pyspark.sql.pandas.types import to_arrow_schema

        with self._open() as connection:
            low, high = connection.execute(f"SELECT min({quoted(key)}), max({quoted(key)}) FROM {quoted(table)}").fetchone()
        parts = 1 if low is None else max(1, min(parts, high - low + 1))
        cuts = [low + (high - low + 1) * k // parts for k in range(1, parts)]
        ranges = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(zip([None, *cuts], [*cuts, None], strict=True))], "k int, low long, high long")
        out = spark.createDataFrame([], schema).schema
        shape = to_arrow_schema(out)
        select = f"SELECT {', '.join(quoted(f.name) for f in out)} FROM {quoted(table)} WHERE ({where or '1'})"

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for one in (r for batch in batches for r in batch.to_pylist()):
                low, high = one["low"], one["high"]
                inside = [f"{quoted(key)} >= {low}"] * (low is not None) + [f"{quoted(key)} < {high}"] * (high is not None)
                within = " AND ".join(inside)
                if low is None and inside:
                    within = f"({within} OR {quoted(key)} IS NULL)"
                with self._open() as connection:
                    found = connection.execute(select + (f" AND {within}" if within else ""))
                    while got := found.fetchmany(fetch):
                        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*got, strict=True), shape.types, strict=True)], schema=shape)

        return ranges.repartitionByRange(parts, "k").mapInArrow(rows, out)

    def index(self, table: str, key: str) -> None:
        """So that a range is read without the others."""
        with self._open() as connection:
            connection.execute(f"CREATE INDEX IF NOT EXISTS {quoted(f'{table}_{key}')} ON {quoted(table)} ({quoted(key)})")
