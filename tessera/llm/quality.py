"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Words are ``[^\\x20\\x09-\\x0D]+``. ``measures`` adds the counts, ``RULES`` says
between which bounds each ratio must lie, and ``quality`` turns the table into
boolean columns and a verdict. No user functions run and nothing is shuffled:
each text is judged in the task that reads it, so copies, hot sources and very
long texts cost no more than their own length (n log n in the words of a text).

Repeated three-word windows are found by sorting a text's 64-bit window hashes;
two different windows of one 20,000-word text share a hash with a probability
of 1e-11.

Null and empty texts have no words and fail the base rule. Rows that repeat and
null ids pass through as they are. Only the id and the text are read, so other
columns, whatever their names, don't matter.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 3

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "a and are as at be by for from in is it of on that the this to was with "
    "avec dans de des du elle est et il la le les par pas pour que qui sur un une "
    "auf das dem den der des die ein eine für ist mit nicht sich und von zu "
    "con del el en es las lo los mi no para por se su una y"
)


@dataclass(frozen=True)
class Rule:
    """``numerator / denominator`` must lie within [least, most]; a bound of None is open."""

    name: str
    numerator: str
    denominator: str
    least: float | None
    most: float | None


RULES = (
    Rule("word_length", "word_chars", "n_words", 3.0, 10.0),
    Rule("symbols", "n_symbols", "n_words", None, 0.1),
    Rule("stop_words", "n_stop_words", "n_words", 0.06, None),
    Rule("line_repeats", "n_dup_lines", "n_lines", None, 0.5),
)
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated(words: Column) -> Column:
    """Words that lie in a window which is found twice or more."""

    def of(w: Column) -> Column:
        hashed = F.transform(F.sequence(F.lit(0), F.size(w) - F.lit(WINDOW)), lambda i: F.struct(F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]).alias("h"), i.alias("p")))
        again = let(F.sort_array(hashed), lambda s: F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])))
        places = F.sort_array(F.transform(again, lambda x: x["p"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(places, start, lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])

    return F.when(F.size(words) > WINDOW, let(words, of)).otherwise(F.lit(0))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the counts that the rules use, all long."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    base = base.select("doc_id", "text", F.array_remove(F.split("text", SPACE), "").alias("words"), F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\f\r", "")) > 0).alias("lines"))
    stop = STOP_WORDS.split()
    return base.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated(F.col("words")).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("words", lambda w: w.isin(stop))).cast("long").alias("n_stop_words"),
    )


def passes(rule: Rule) -> Column:
    """True where the rule holds; without a denominator there is nothing to object to."""
    top, bottom = F.col(rule.numerator).cast("double"), F.col(rule.denominator).cast("double")
    holds = F.lit(True)
    if rule.least is not None:
        holds = holds & (top >= F.lit(rule.least) * bottom)
    if rule.most is not None:
        holds = holds & (top <= F.lit(rule.most) * bottom)
    return holds


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts, ``base_failed``, a column ``rule_<name>`` for each rule, and ``kept``."""
    out = measures(docs, id_col, text_col)
    failed = (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * F.col("n_words"))
    kept = ~failed
    for rule in rules:
        kept = kept & passes(rule)
    return out.select("*", failed.alias("base_failed"), *[passes(r).alias(f"rule_{r.name}") for r in rules], kept.alias("kept"))
