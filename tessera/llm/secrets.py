"""Secret scan over a trigram inverted index.

1. Each rule's regular expression gives a Boolean query of trigrams
   (``trigram_query``): a text that the rule matches holds all trigrams of at least
   one of the query's terms.
2. ``trigram_index`` numbers the rows and writes the texts and the postings (trigram,
   row): the trigrams of any query that a text holds, each once. Every part file is a
   shard of the index, in order of trigrams, so a query's scan skips the row groups of
   others.
3. ``candidates`` intersects the postings: a bit for each trigram, united by row (in
   the map task, since a row's postings lie in one shard), against the terms' masks.
4. ``secret_scan`` brings the candidate rules back to the texts, by the unique row
   number, and verifies them: the expressions run only where their rule is a
   candidate. Rules without mandatory trigrams run over every text.

All of it is DataFrame functions. Rows move once, by a unique number, so copies and
hot sources are dealt evenly; what is broadcast is the table of the rules' own
trigrams. Offsets are code points, ends exclusive.

A null text is an empty one: no spans, counts 0, the hash of no bytes. Rows that
repeat, or whose id is null, each have their own result. Only the id and the text
are read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import matches
from .common import Scratch
from .trigram_query import NOTHING, Query, trigram_query

BITS = 62
#: Trigrams asked for of a term, those with the fewest frequent letters.
MOST_GRAMS, FREQUENT = 3, " etaoinshr"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: what it looks like, and how long the given group has to be."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0

    @property
    def query(self) -> Query:
        """The trigram query, with the MOST_GRAMS rarest trigrams of each term: what has them all has any fewer."""
        return frozenset(frozenset(sorted(term, key=lambda g: (sum(c in FREQUENT for c in g), g))[:MOST_GRAMS]) for term in trigram_query(self.pattern))


# The base rules. A run that is too short fails as a whole, so bounds on the last class say the same for access and hex.
BASE = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
# Shapes of keys that services publish, private key headers and passwords in urls.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,255}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,255}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[sr]k_(?:live|test)_[0-9A-Za-z]{16,255}"),
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,999}\.eyJ[A-Za-z0-9_-]{8,999}\.[A-Za-z0-9_-]{8,999}"),
    Rule("url_password", r"[A-Za-z][A-Za-z0-9+.-]{0,15}://[^\x09-\x0D\x20/:@]{1,99}:[^\x09-\x0D\x20/:@]{3,99}@"),
)
RULES = BASE + MORE


def _all_grams(rules: tuple[Rule, ...]) -> list[str]:
    return sorted(set().union(*(term for rule in rules for term in rule.query)))


def trigram_index(docs: DataFrame, rules: tuple[Rule, ...], scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts: row, doc_id, text; postings: gram, row), both written."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = scratch.cut(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), text.alias("text")), "texts")
    grams = _all_grams(rules)
    if not grams:
        return texts, docs.sparkSession.createDataFrame([], "gram string, row long")
    folded = texts.select("row", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]))
    postings = folded.select(F.explode(held).alias("gram"), "row").sortWithinPartitions("gram", "row")
    return texts, scratch.cut(postings, "postings")


def candidates(postings: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(row, rules): the numbers of the rules one of whose terms has all its trigrams in the row."""
    grams = _all_grams(rules)
    if not grams:
        return postings.select("row", F.lit(None).cast("array<int>").alias("rules")).limit(0)
    bit_of = {g: divmod(i, BITS) for i, g in enumerate(grams)}
    table = postings.sparkSession.createDataFrame([(g, word, 1 << bit) for g, (word, bit) in bit_of.items()], "gram string, word int, bit long")
    words = range((len(grams) - 1) // BITS + 1)
    united = postings.where(F.col("gram").isin(grams)).join(F.broadcast(table), "gram").groupBy("row").agg(*[F.coalesce(F.bit_or(F.when(F.col("word") == w, F.col("bit"))), F.lit(0)).alias(f"m{w}") for w in words])

    def holds(term: frozenset[str]) -> Column:
        masks = {w: sum(1 << bit_of[g][1] for g in term if bit_of[g][0] == w) for w in words}
        out = F.lit(True)
        for w, mask in masks.items():
            if mask:
                out = out & (F.col(f"m{w}").bitwiseAND(F.lit(mask).cast("long")) == F.lit(mask).cast("long"))
        return out

    found = [F.when(reduce(or_, [holds(t) for t in sorted(rule.query, key=sorted)]), F.lit(k)) for k, rule in enumerate(rules) if rule.query != NOTHING]
    return united.select("row", F.array_compact(F.array(*found)).alias("rules")).where(F.size("rules") > 0)


def _spans(text: Column, rule: Rule, number: int) -> Column:
    """array<struct<start, kind, end>> of a rule's matches, without those whose group is too short."""
    found = matches(text, rule.pattern, value=rule.group)
    if rule.least:
        found = F.filter(found, lambda m: F.length(m["value"]) >= rule.least)
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(number).alias("kind"), m["end"].alias("end")))


def secret_scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, found`` of each row: array<struct<start int, kind int, end int>>, in order; kind is the rule's number."""
    scratch = Scratch(docs.sparkSession, "secrets")
    texts, postings = trigram_index(docs, rules, scratch, id_col, text_col)
    chosen = scratch.cut(candidates(postings, rules).withColumnRenamed("row", "at"), "candidates")
    joined = texts.join(chosen.hint("shuffle_hash"), F.col("row") == F.col("at"), "left")
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")

    def of(number: int, rule: Rule) -> Column:
        spans = _spans(F.col("text"), rule, number)
        return spans if rule.query == NOTHING else F.when(F.array_contains("rules", number), spans).otherwise(none)

    return joined.select("doc_id", F.sort_array(F.concat(none, *[of(k, r) for k, r in enumerate(rules)])).alias("found"))


def shown(found: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The spans as ``kind:start:end``, joined by commas."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
