"""Stages as DataFrame functions over tables, with resumable runs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .corpus import lookup
from .spans import best_spans, demoted, ranked



@dataclass(frozen=True)
class Stage:
    """name, and what makes its output table from the input rows; ready: which output rows count as done."""

    name: str
    make: Callable[[DataFrame], DataFrame]
    ready: str = "status = 'ok'"


def pending(ids: DataFrame, done: DataFrame | None, key: str, ready: str = "status = 'ok'", limit: int | None = None, force: bool = False) -> DataFrame:
    """Keys that have no finished output; the limit comes last, so that every run gets on."""
    out = ids.select(key).distinct()
    if done is not None and not force:
        out = out.join(done.where(ready).select(key).distinct(), key, "left_anti")
    return out.orderBy(key).limit(limit) if limit is not None else out


def fresh_first(ids: DataFrame, done: DataFrame, key: str, limit: int) -> DataFrame:
    """Keys that are not done before those that are (a run's worth of ``limit``)."""
    flagged = ids.select(key).distinct().join(done.select(key).distinct().withColumn("is_done", F.lit(True)), key, "left").withColumn("is_done", F.coalesce("is_done", F.lit(False)))
    return flagged.orderBy("is_done", key).limit(limit)


class Runner:
    """Runs stages over tables in ``root``: each appends the rows of keys that are not done, and a row to the log of runs."""

    def __init__(self, spark: SparkSession, root: str, key: str):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key

    def table(self, name: str) -> DataFrame | None:
        path = f"{self.root}/{name}"
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return None
        return self.spark.read.parquet(path)

    def run(self, stage: Stage, source: DataFrame, limit: int | None = None) -> int:
        ids = pending(source, self.table(stage.name), self.key, stage.ready, limit)
        todo = source.join(ids, self.key, "left_semi")
        stage.make(todo).write.mode("append").parquet(f"{self.root}/{stage.name}")
        counted = ids.count() if limit is not None else 0
        log = self.spark.createDataFrame([(stage.name, limit, counted)], "stage string, run_limit int, n_limited long")
        log.withColumn("ended", F.current_timestamp()).write.mode("append").parquet(f"{self.root}/_runs")
        return counted

    def run_all(self, stages: Sequence[Stage], source: DataFrame) -> DataFrame:
        for stage in stages:
            self.run(stage, source)
            source = self.spark.read.parquet(f"{self.root}/{stage.name}")
        return source


def with_failures(df: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """Rows with status and error: a row that a check refuses is kept, and the others go on."""
    error = F.coalesce(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in checks.items()])
    return df.withColumn("error", error).withColumn("status", F.when(F.col("error").isNull(), "ok").otherwise("failed"))


def assemble(inventory: DataFrame, spans: DataFrame, downloads: DataFrame, model: str) -> DataFrame:
    """One nested row an event: its documents with their download status, its ranked facts, and what is exceptional.

    A cached download counts as a success.
    """
    best = best_spans(demoted(ranked(spans)))
    facts = best.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("rank_score")).alias("order"), F.col("span_id"), F.col("field_hint"), F.col("text").alias("raw"), F.col("rank_score"), F.col("method"), F.col("passage")))).alias("candidate_facts"))
    docs = inventory.join(downloads.select("accession", "filename", F.col("status").alias("download_status")), ["accession", "filename"], "left").withColumn("download_status", F.coalesce("download_status", F.lit("unknown")))
    got = F.col("download_status").isin("ok", "skipped")
    docs = docs.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("role", "accession", "filename", "download_status"))).alias("docs"), F.bool_or(got & (F.col("role") == "sc_14d9")).alias("has_14d9_text"))
    out = docs.join(facts, "event_id", "left")
    flags = F.array_compact(F.array(F.when(~F.col("has_14d9_text"), "missing_14d9"), F.when(F.col("candidate_facts").isNull(), "no_facts")))
    return out.select("event_id", F.concat(F.col("event_id"), F.lit(":v1")).alias("rep_id"), F.lit(model).alias("model"), "docs", "candidate_facts", flags.alias("exceptions"), F.when(F.col("candidate_facts").isNull(), "failed").otherwise("ok").alias("status"))


def rep_tables(reps: DataFrame, path: str, allowed_methods: Sequence[str] = ("rule", "model")) -> dict[str, DataFrame]:
    """The tables of assembled rows: reps, documents, facts; a fact of a method that isn't allowed fails the read."""
    named = reps.withColumn("path", F.lit(path))
    facts = named.select("path", "event_id", "rep_id", F.posexplode("candidate_facts").alias("fact_no", "f")).select("path", "event_id", "rep_id", "fact_no", "f.field_hint", "f.raw", "f.rank_score", "f.method", "f.passage")
    bad = ~F.col("method").isin(*allowed_methods)
    facts = facts.where(F.when(bad, F.raise_error(F.concat(F.lit("method not allowed: "), F.col("method"))).cast("boolean")).otherwise(F.lit(True)))
    documents = named.select("path", "event_id", "rep_id", F.explode("docs").alias("d")).select("path", "event_id", "rep_id", "d.*")
    return {"reps": named.select("path", "event_id", "rep_id", "model", "status", "exceptions"), "documents": documents, "facts": facts}


def stage_metrics(manifests: DataFrame) -> DataFrame:
    """Nested stage manifests as flat rows; what is nested deeper stays JSON."""
    flat = [F.to_json(c).alias(c) if t.startswith(("struct", "array", "map")) else F.col(c) for c, t in manifests.dtypes]
    return manifests.select(*flat)


#: Event paths: only the first has stages; the others report that they have none.
PATHS = {"tender": True, "exchange": False, "rights": False, "merger": False, "conversion": False}


PATH_OF = {"tender_offer": "tender", "exchange_offer": "exchange", "rights_issue": "rights", "merger": "merger", "conversion": "conversion"}


def path_status(events: DataFrame, kind: str = "event_type") -> DataFrame:
    """Each path, whether it has stages, and how many of the events would take it."""
    paths = events.sparkSession.createDataFrame([(p, "implemented" if ok else "stub_not_implemented") for p, ok in PATHS.items()], "path string, status string")
    counted = events.groupBy(lookup(PATH_OF, F.col(kind)).alias("path")).agg(F.count(F.lit(1)).alias("n_events"))
    return paths.join(F.broadcast(counted), "path", "left").withColumn("n_events", F.coalesce("n_events", F.lit(0)).cast("long"))


def manifests(texts: DataFrame, text: str = "value") -> DataFrame:
    """Stage manifests of any shape: ``stage, status, ended`` and ``metrics``, all else as a variant; text that is no object has nulls.

    Shapes may differ from row to row and from run to run; nothing has to be known of
    the metrics when they are read or written.
    """
    v = F.try_parse_json(F.col(text))
    get = lambda name: F.try_variant_get(v, f"$.{name}", "string")
    return texts.select(get("stage").alias("stage"), get("status").alias("status"), F.try_to_timestamp(get("ended")).alias("ended"), v.alias("metrics"))


def metric_rows(table: DataFrame) -> DataFrame:
    """A row for each entry of each manifest but the common ones: ``metric`` and its ``value`` as JSON text."""
    keep = [c for c in table.columns if c != "metrics"]
    entries = table.lateralJoin(table.sparkSession.tvf.variant_explode(F.col("metrics").outer()))
    rows = entries.where("key is not null and key not in ('stage', 'status', 'ended')")
    return rows.select(*keep, F.col("key").alias("metric"), F.to_json(F.col("value")).alias("value"))


def metric_shapes(table: DataFrame, *by: str) -> DataFrame:
    """The one schema that the manifests of each group fit."""
    return table.groupBy(*by).agg(F.schema_of_variant_agg("metrics").alias("shape"), F.count(F.lit(1)).alias("n"))
