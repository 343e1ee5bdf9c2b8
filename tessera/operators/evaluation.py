"""Scoring of predictions against references, validation of inputs, and screening queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import REVIEWED
from ..functions.frames import precision_recall, ratio
from ..functions.text import compare, normalized, parity_cohort, soft_match


def summed(outcomes: DataFrame, by: list[str], micro: str = "(all)") -> DataFrame:
    """tp, fp, fn, scored, precision, recall and f1 of each field and of all fields, from one aggregation.

    outcomes: the columns ``by``, field, and outcome; a mismatch counts as a false
    positive and as a false negative.
    """
    o = F.col("outcome")
    counts = [
        F.count_if(o == "tp").alias("tp"), F.count_if(o.isin("mismatch", "fp")).alias("fp"), F.count_if(o.isin("mismatch", "fn")).alias("fn"),
        F.count_if(o == "tn").alias("tn"), F.count_if(o.isin("tp", "mismatch", "fp", "fn", "tn")).alias("scored"),
    ]
    sets = outcomes.groupingSets([[*[F.col(b) for b in by], F.col("field")], [F.col(b) for b in by]], *by, "field").agg(*counts)
    return sets.select(*by, F.coalesce("field", F.lit(micro)).alias("field"), "tp", "fp", "fn", "tn", "scored", *precision_recall(F.col("tp"), F.col("fp"), F.col("fn")), F.round(ratio(F.col("tp") + F.col("tn"), F.col("scored")), 6).alias("accuracy"))


def top1_outcomes(reference: DataFrame, predictions: DataFrame, scope: str = "overlap", gold_missing_is_blank: bool = True) -> DataFrame:
    """The outcome of each cell of ``reference`` (row_id, accession, field, gold) given ``predictions`` (accession, field, value).

    overlap: only filings that have predictions; all: every row. Cells blank on both
    sides are left out. gold_missing_is_blank: whether a gold value like "N/A" is
    blank, or counts as a value that no prediction meets.
    """
    if scope not in ("overlap", "all"):
        raise ValueError("scope must be overlap or all")
    cells = reference.withColumn("accession", F.trim("accession"))
    if scope == "overlap":
        cells = cells.join(predictions.select("accession").distinct(), "accession", "left_semi")
    both = cells.join(predictions.select("accession", "field", F.col("value").alias("predicted")), ["accession", "field"], "left")
    p, g = normalized(F.col("predicted")), normalized(F.col("gold"))
    said, there = (p != ""), (g != "") if gold_missing_is_blank else F.coalesce("gold", F.lit("")) != ""
    outcome = F.when(said & there, F.when(soft_match(F.col("predicted"), F.col("gold")), "tp").otherwise("mismatch")).when(said, "fp").otherwise("fn")
    return both.where((p != "") | (g != "")).withColumn("outcome", outcome)


def reviewed_outcomes(reference: DataFrame, predictions: DataFrame) -> DataFrame:
    """Outcomes of filings with one reviewed reference row, and why the others are excluded (accession, field, outcome).

    Exclusions are rows with a null field, in this order: several reference rows,
    not reviewed, no prediction at all.
    """
    # Filings with several rows (or none with an id) need no cells: they are told by one aggregation, and only the others are joined.
    ids = reference.select("accession", "row_id", F.lit(True).alias("referred"), F.lit(False).alias("predicted"))
    ids = ids.unionByName(predictions.select("accession", F.lit(False).alias("referred"), F.lit(True).alias("predicted")), allowMissingColumns=True)
    filings = ids.where("accession is not null").groupBy("accession").agg(F.min("row_id").alias("low"), F.max("row_id").alias("high"), F.bool_or("referred").alias("referred"), F.bool_or("predicted").alias("predicted"))
    filings = filings.where("referred and predicted").select("accession", F.coalesce(F.col("low") == F.col("high"), F.lit(False)).alias("single"))
    one = filings.where("single").select("accession")
    rows = reference.select("accession", "field", "gold", F.lower(F.trim(F.coalesce("review_status", F.lit("")))).alias("status")).join(one, "accession", "left_semi")
    both = rows.join(predictions.select("accession", "field", F.col("value").alias("predicted")), ["accession", "field"], "left").withColumn("p", normalized(F.col("predicted"))).withColumn("g", normalized(F.col("gold")))
    shape = both.groupBy("accession").agg(F.max("status").alias("status"), F.bool_or(F.col("p") != "").alias("has"))
    why = F.when(~F.col("status").isin(*REVIEWED), "reference_not_reviewed").when(~F.col("has"), "canonical_prediction_missing")
    judged = shape.select("accession", why.alias("why"))
    p, g = F.col("p"), F.col("g")
    outcome = F.when((p == "") & (g == ""), "tn").when(p == g, "tp").when((p != "") & (g != ""), "mismatch").when(p != "", "fp").otherwise("fn")
    scored = both.join(judged.where("why is null").select("accession"), "accession", "left_semi").select("accession", "field", outcome.alias("outcome"))
    excluded = filings.where("not single").select("accession", F.lit("multiple_reference_rows_per_filing").alias("why")).unionByName(judged.where("why is not null"))
    return scored.unionByName(excluded.select("accession", F.lit(None).cast("string").alias("field"), F.col("why").alias("outcome")))


def deal_outcomes(gold: DataFrame, predictions: DataFrame, exact: tuple[str, ...], dates: tuple[str, ...], cash: tuple[str, ...]) -> DataFrame:
    """Outcomes of reviewed cells aligned by deal.

    gold: accession, reference_row_id, deal_id, field, gold_state, gold_value,
    review_status, comparison_override; predictions: accession, deal_id, field,
    predicted_value. A prediction without a deal counts for a filing with one
    reference row. Exclusions come first, in the order of the cases below.
    """
    blank = lambda c: F.trim(F.coalesce(c, F.lit("")))
    g = gold.select(*[blank(F.col(c)).alias(c) for c in ("accession", "reference_row_id", "deal_id", "field", "gold_state", "gold_value", "review_status", "comparison_override")])
    rows = g.groupBy("accession").agg(F.count_distinct("reference_row_id").alias("n_rows"))
    p = predictions.select("accession", blank(F.col("deal_id")).alias("deal_id"), "field", blank(F.col("predicted_value")).alias("value"))
    own = p.withColumnRenamed("value", "own")
    general = p.where("deal_id = ''").select("accession", "field", F.col("value").alias("general"))
    j = g.join(rows, "accession").join(own, ["accession", "deal_id", "field"], "left").join(general, ["accession", "field"], "left")
    predicted = F.coalesce("own", F.when(F.col("n_rows") == 1, F.col("general")), F.lit(""))
    state = F.lower("gold_state")
    verdict = compare(F.col("field"), predicted, F.col("gold_value"), F.lower("comparison_override"), exact, dates, cash)
    outcome = (
        F.when(~F.lower("review_status").isin(*REVIEWED), "not_reviewed")
        .when(state == "unknown", "unknown_gold")
        .when(F.col("deal_id") == "", "missing_deal_id")
        .when((F.col("n_rows") > 1) & F.col("own").isNull(), "multi_deal_unaligned")
        .when((state == "absent") & (predicted == ""), "tn")
        .when(state == "absent", "fp")
        .when(predicted == "", "fn")
        .when(verdict == "match", "tp")
        .when(verdict == "mismatch", "mismatch")
        .otherwise("needs_comparison_review")
    )
    return j.select("accession", "deal_id", "field", "gold_state", "gold_value", predicted.alias("predicted_value"), outcome.alias("outcome"))


def with_cohorts(df: DataFrame, key: str) -> DataFrame:
    """Each row in the cohort of its key and in all."""
    return df.withColumn("cohort", F.explode(F.array(F.lit("all"), parity_cohort(F.col(key)))))


def compare_variants(outcomes: dict[str, DataFrame], key: str) -> DataFrame:
    """Precision and recall of each variant, of all its rows and of both cohorts. outcomes: by variant, rows with field, outcome and ``key``."""
    all_ = None
    for name, rows in outcomes.items():
        tagged = rows.select(key, "field", "outcome").withColumn("variant", F.lit(name))
        all_ = tagged if all_ is None else all_.unionByName(tagged)
    return summed(with_cohorts(all_, key), ["variant", "cohort"])


def evidence_agreement(quotes: DataFrame, candidates: DataFrame) -> DataFrame:
    """Of each field: how many distinct candidate values a quote contains, and how many cells have candidates.

    quotes: accession, field, quote; candidates: accession, field, value.
    """
    bare = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    cells = quotes.groupBy("accession", "field").agg(F.collect_set(bare(F.col("quote"))).alias("quotes"))
    values = candidates.select("accession", "field", bare(F.col("value")).alias("key")).where("key <> ''").distinct()
    j = cells.join(values, ["accession", "field"], "left").withColumn("hit", F.exists("quotes", lambda q: F.contains(q, F.col("key"))))
    one = j.groupBy("accession", "field").agg(F.count("key").alias("n_values"), F.count_if(F.coalesce("hit", F.lit(False))).alias("n_supported"))
    out = one.groupBy("field").agg(F.count(F.lit(1)).alias("n_cells"), F.count_if(F.col("n_values") > 0).alias("n_covered"), F.sum("n_values").alias("n_values"), F.sum("n_supported").alias("n_supported"))
    return out.select("*", F.round(ratio(F.col("n_supported"), F.col("n_values")), 6).alias("supported"), F.round(ratio(F.col("n_covered"), F.col("n_cells")), 6).alias("covered"))


def reference_coverage(reference: DataFrame, available: DataFrame, selected: DataFrame) -> DataFrame:
    """How many reference filings the archive and the selection have."""
    keys = reference.select(F.trim("accession").alias("accession")).groupBy("accession").agg(F.count(F.lit(1)).alias("n"))
    flags = keys.join(available.select("accession").distinct().withColumn("a", F.lit(1)), "accession", "left").join(selected.select("accession").distinct().withColumn("s", F.lit(1)), "accession", "left")
    return flags.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("reference_rows"), F.count(F.lit(1)).alias("reference_accessions"), F.count("a").alias("in_archive"), F.count("s").alias("selected"), F.count_if(F.col("a").isNull()).alias("missing"))


def review_cells(reference: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """A blank cell for review for each reference row and field; ``reference`` has a column for each field."""
    ids = [c for c in reference.columns if c not in fields]
    cells = reference.unpivot(ids, list(fields), "field", "reference_value")
    return cells.withColumns({c: F.lit("") for c in ("gold_state", "gold_value", "review_status", "comparison_override")})


def refuse(df: DataFrame, bad: Column, message: str) -> DataFrame:
    """The same rows; reading one for which ``bad`` holds fails with the message."""
    checked = F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True))
    return df.where(checked)


def unique_by(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, which a caller refuses."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def review_priority(evidence: Column, filing_date: Column) -> Column:
    """'high' if a signing or completion is quoted with the filing's year, 'medium' if anything is, else 'low'."""
    types = F.transform(evidence, lambda e: e["event_type"])
    year = F.substring(filing_date.cast("string"), 1, 4)
    current = F.exists(evidence, lambda e: F.rlike(F.coalesce(e["excerpt"], F.lit("")), F.concat(F.lit(r"\b"), year, F.lit(r"\b"))))
    strong = F.arrays_overlap(types, F.array(F.lit("merger_agreement_signed"), F.lit("merger_completed")))
    return F.when(current & strong, "high").when(F.size(evidence) > 0, "medium").otherwise("low")


REVIEW_COLUMNS = ("review_label", "reviewer", "reviewed_at", "confirmed_evidence", "deal_id", "review_note")


def screen(documents: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """The review queue of documents (accession, filing_date, text, evidence); decisions carry over where the text is the same."""
    evidence = F.coalesce("evidence", F.array().cast("array<struct<event_type:string,excerpt:string>>"))
    excerpts = F.filter(F.transform(evidence, lambda e: e["excerpt"]), lambda x: F.coalesce(x, F.lit("")) != "")
    out = documents.select(
        "accession", "filing_date", F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"), review_priority(evidence, F.col("filing_date")).alias("suggested_priority"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(evidence, lambda e: e["event_type"]))), ";").alias("evidence_types"),
        F.coalesce(F.substring(F.get(excerpts, F.lit(0)), 1, 1200), F.lit("")).alias("suggested_evidence"),
    )
    if previous is None:
        return out.withColumns({c: F.lit("") for c in REVIEW_COLUMNS})
    old = previous.select("accession", "text_sha256", *REVIEW_COLUMNS)
    return out.join(old, ["accession", "text_sha256"], "left").withColumns({c: F.coalesce(c, F.lit("")) for c in REVIEW_COLUMNS})


def stale_reviews(queue: DataFrame, documents: DataFrame) -> DataFrame:
    """What is wrong with each confirmed review: changed text, a quote that isn't in it, no date."""
    j = queue.where("review_label = 'confirmed'").join(documents.select("accession", "text"), "accession", "left")
    text = F.coalesce("text", F.lit(""))
    bad = lambda test, name: F.when(F.coalesce(test, F.lit(True)), F.lit(name))
    problems = F.array_compact(F.array(
        bad(F.col("text_sha256") != F.sha2(F.encode(text, "UTF-8"), 256), "text_changed"), bad(F.coalesce("confirmed_evidence", F.lit("")) == "", "no_evidence"),
        bad(~F.contains(text, F.coalesce("confirmed_evidence", F.lit(""))), "quote_not_in_text"), bad(F.col("reviewed_at").try_cast("date").isNull(), "no_review_date"),
    ))
    return j.select("accession", F.array_join(problems, ";").alias("problems"))


def column_drift(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys that one side lacks, or whose columns differ."""
    j = left.select(key, *[F.col(c).alias(f"l_{c}") for c in columns], F.lit(1).alias("l")).join(right.select(key, *[F.col(c).alias(f"r_{c}") for c in columns], F.lit(1).alias("r")), key, "full_outer")
    differ = F.array_compact(F.array(*[F.when(~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}")), F.lit(c)) for c in columns]))
    what = F.when(F.col("l").isNull(), "only_right").when(F.col("r").isNull(), "only_left").when(F.size(differ) > 0, F.array_join(differ, ","))
    return j.select(key, what.alias("drift")).where("drift is not null")
