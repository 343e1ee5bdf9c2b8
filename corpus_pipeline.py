"""The corpus pipeline: five stages, each on all that the one before kept.

Toxic documents go, one document of each near-duplicate group stays, repeated
passages are cut out, documents that leak benchmark items go, and what is left
is packed into sequences. Stages return the columns of ``documents``; each result
is written to the shared folder as Parquet and read again by the next.

A row is a document, whatever its doc_id: where results have to come back to their
rows, the stage numbers the rows itself. So rows that share a doc_id, or have none,
are judged one by one. Of a near-duplicate group the row with the least doc_id stays
(ties and null ids: the first written); documents without words are in no group and
stay. Documents of which the third stage leaves no word go; where it removes words,
the rest is joined by single spaces and n_chars counted anew. Toxicity is learnt
from the labels that are not held out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch
from tessera.llm.decontamination import without_leaks
from tessera.llm.near_dedup import near_duplicates
from tessera.llm.op_queries.op4 import held_out
from tessera.llm.packing import pack
from tessera.llm.substrings import substring_dedup
from tessera.llm.tokenizer_files import tokenizer_path
from tessera.llm.toxicity import fit, without_toxic

TOXIC = 0.7

#: SQL expresses neither the fitted scores nor the token ids; tests/llm/test_pipeline.py holds each stage against a brute-force version instead.
ORACLE_SQL = None


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _numbered(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a number each, written so that it stays theirs, in a column that no other is named like."""
    name = "row"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return Scratch(spark, "pipeline-rows").cut(docs.withColumn(name, F.monotonically_increasing_id()), "rows"), name


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score, learnt from the labels, is below TOXIC."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    return without_toxic(docs, fit(docs, labels), TOXIC)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each component of near duplicates."""
    rows, number = _numbered(spark, docs)
    member = near_duplicates(rows, id_col=number).select(F.col("doc_id").alias("of"), F.col("component_id").alias("component"))
    member = Scratch(spark, "pipeline-groups").cut(member.join(rows.select(F.col(number).alias("n"), F.col("doc_id").alias("id")), F.col("of") == F.col("n")), "members")
    first = member.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("a"), "id", "n")).alias("first"))
    gone = member.join(first.select("first.n"), "n", "left_anti").select(F.col("n").alias("gone"))
    return rows.join(gone, F.col(number) == F.col("gone"), "left_anti").select(*map(_quoted, docs.columns))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated passages; those of which nothing is left go."""
    rows, number = _numbered(spark, docs)
    cut = substring_dedup(rows, id_col=number, with_text=True).where("n_removed > 0").select(F.struct("doc_id", "kept_text").alias("cut"))
    out = rows.select(F.struct(*map(_quoted, rows.columns)).alias("d")).join(cut, F.col("d")[number] == F.col("cut.doc_id"), "left")
    out = out.where("cut is null or cut.kept_text <> ''")
    left, old = F.col("cut.kept_text"), lambda c: F.col("d").getField(c)
    changed = {"text": F.coalesce(left, old("text")), "n_chars": F.when(F.col("cut").isNull(), old("n_chars")).otherwise(F.length(left).cast("long"))}
    return out.select(*[(changed[c] if c in changed else old(c)).alias(c) for c in docs.columns])


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens, with their ids as little-endian 32-bit numbers."""
    return pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substrings", substring_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
