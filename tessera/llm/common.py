"""What the operators share: scratch tables, code shipping and connected components."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
_OWN_ROOTS: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Give every executor a copy of this package, once per application.

    The archive travels through Spark's own file server, so it also reaches
    executors that start later or replace a lost one.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="tessera-"), f"{root.name}.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(root.rglob("*")):
            if path.suffix in (".py", ".npz"):
                archive.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the session names; a temporary one only in local mode, as in tests. On a cluster it must be named."""
    app = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if app not in _OWN_ROOTS:
            _OWN_ROOTS[app] = Path(tempfile.mkdtemp(prefix="tessera-scratch-")).as_uri()
        base = _OWN_ROOTS[app]
    return f"{base.rstrip('/')}/tessera/{app}"


class Scratch:
    """Intermediate tables in the shared folder, which survive lost executors and cut the lineage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0

    def folder(self, label: str) -> str:
        """A new folder, which goes when the application ends."""
        self.count += 1
        if self.count == 1:
            at, files = self._at(self.base)
            files.deleteOnExit(at)
        return f"{self.base}/{self.count:03d}-{label}"

    def cut(self, df: DataFrame, label: str) -> DataFrame:
        """Write ``df`` and return a reader of what was written."""
        path = self.folder(label)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later read needs."""
        for table in tables:
            at, files = self._at(table._scratch_path)
            files.delete(at, True)

    def _at(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())


def plain_names(df: DataFrame) -> DataFrame:
    """The columns by number, for functions that don't take names with dots or twice the same."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(id, root)`` for every id in ``edges(a, b)``; root is the smallest id reachable.

    Randomised contraction. In each round every node takes as its label the
    neighbour (or itself) of the smallest pseudo-random priority, which differs
    from round to round; edges between different labels are carried on. A
    constant share of the nodes disappears in a round, so the number of rounds
    grows with the logarithm of the largest component, whatever its shape. All
    steps are equi-joins and partial aggregations; nothing reaches the driver
    but the emptiness of the edge list.

    Null ends and self-loops are ignored. Empty input gives an empty result.
    """
    pairs = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    pairs = scratch.cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    turn = 0
    while not pairs.isEmpty():
        both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("p"), c.alias("n"))
        step = both.groupBy("a").agg(F.min(rank(F.col("b"))).alias("near")).select(F.col("a").alias("old"), F.least(F.col("near"), rank(F.col("a"))).getField("n").alias("new"))
        step = scratch.cut(step, "step")
        moved = (
            pairs.join(step, F.col("a") == F.col("old")).select(F.col("new").alias("a"), "b")
            .join(step, F.col("b") == F.col("old")).select("a", F.col("new").alias("b"))
            .where("a <> b")
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        )
        moved = scratch.cut(moved, "edges")
        if labels is None:
            grown = step.select(F.col("old").alias("id"), F.col("new").alias("label"))
        else:
            grown = labels.join(step, F.col("label") == F.col("old"), "left").select("id", F.coalesce("new", "label").alias("label"))
        grown = scratch.cut(grown, "labels")
        scratch.drop(pairs, step, *([labels] if labels is not None else []))
        pairs, labels, turn = moved, grown, turn + 1
    if labels is None:
        return edges.sparkSession.createDataFrame([], "id long, root long")
    roots = labels.groupBy("label").agg(F.min("id").alias("root"))
    return labels.join(roots, "label").select("id", "root")
