"""Candidate spans: value-aware ranking, deduplication, rerankers, quality gates, review clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import ADVISORY, AGENTS, BOILERPLATE_SECURITIES, DATE_CUES, GENERIC_ROLES, HEADINGS, LABEL_HINTS, NO_DATE_CONTEXT, ORGANIZATION_ENDING, ROLE_BONUS, SHELLS, WEAK_SECURITIES
from ..functions.frames import top_per_key
from ..functions.text import CALENDAR_DATE, COMPANY_ENDING, CUSIP, MONEY, TICKER, normalized, spaces
from .corpus import lookup

THRESHOLD = 0.4
PARTIES = ("offeror", "target", "purchaser")
DATES = ("expiration_date", "withdrawal_deadline", "effective_date", "settlement_date", "payment_date")


def _flat(text: Column) -> Column:
    return F.lower(spaces(F.coalesce(text, F.lit(""))))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def is_heading(text: Column) -> Column:
    """A heading rather than a value: a known phrase, or short, without digits, and ending like one."""
    n = _flat(text)
    ends = n.endswith("price") | n.endswith("time") | n.endswith("date") | n.endswith("condition")
    return (F.length(n) < 2) | n.isin(*HEADINGS) | ((F.length(n) < 40) & ~n.rlike(r"\d") & ends)


def is_agent(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(AGENTS)


def is_shell(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit(""))).rlike(SHELLS)


def is_legal_name(text: Column) -> Column:
    t = F.trim(F.coalesce(text, F.lit("")))
    return (F.length(t) >= 5) & (n_words(t) >= 2) & (t.rlike(COMPANY_ENDING) | F.contains(t, F.lit(",")))


def value_bonus(hint: Column, text: Column) -> Column:
    """What the shape of a value says for its field."""
    t = F.coalesce(text, F.lit(""))
    bare = F.trim(t)
    party = (
        F.when(is_heading(t) | is_shell(t), -0.35).when(is_agent(t), -0.55).when(is_legal_name(t), 0.3)
        .when(n_words(t) >= 2, 0.1).when(F.length(bare) < 5, -0.25)
    )
    security = F.when(_flat(t).isin(*WEAK_SECURITIES), -0.4).when(F.length(bare) < 5, -0.35).when(is_legal_name(t) | (F.length(t) > 20), 0.2)
    currency = F.when(F.upper(bare).isin("USD", "EUR", "GBP", "CAD", "JPY"), 0.4).when(F.contains(t, F.lit("$")) & (F.length(bare) <= 3), 0.1).when(F.contains(t, F.lit("\n")) | (F.length(t) > 12), -0.3)
    out = (
        F.when(hint.isin("offer_price", "cash_amount"), F.when(t.rlike(MONEY), 0.45))
        .when(hint.isin(*DATES), F.when(t.rlike(CALENDAR_DATE), 0.45))
        .when(hint == "cusip", F.when(bare.rlike(CUSIP), 0.5))
        .when(hint == "ticker", F.when(bare.rlike(TICKER), 0.35))
        .when(hint.isin(*PARTIES), party)
        .when(hint == "security_description", security)
        .when(hint == "currency", currency)
    )
    return F.coalesce(out, F.lit(0.0))


def role_bonus(hint: Column, role: Column, kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for (h, r), b in ROLE_BONUS.items() for x in (f"{h}|{r}", b)])
    base = F.coalesce(table[F.concat_ws("|", hint, F.lower(F.coalesce(role, F.lit(""))))], F.lit(0.0))
    near = hint.isin("offer_price", "expiration_date", "withdrawal_deadline") & F.lower(F.coalesce(kind, F.lit(""))).isin("faq", "priority_section")
    return base + F.when(near, 0.08).otherwise(0.0)


def ranked(spans: DataFrame) -> DataFrame:
    """``field_hint`` and ``rank_score`` of each span (label, text, score, doc_role, segment_kind, priority)."""
    hint = F.coalesce(lookup(LABEL_HINTS, F.col("label")), F.col("label"), F.lit("other"))
    out = spans.withColumn("field_hint", hint)
    h, t = F.col("field_hint"), F.col("text")
    urgent = F.lower(F.coalesce("segment_kind", F.lit(""))).isin("faq", "priority_section") | F.coalesce("priority", F.lit(False))
    score = F.coalesce("score", F.lit(0.0)) + value_bonus(h, t) + role_bonus(h, F.col("doc_role"), F.col("segment_kind"))
    return out.withColumn("rank_score", score - F.when(is_heading(t), 0.55).otherwise(0.0) + F.when(urgent, 0.05).otherwise(0.0))


def demoted(spans: DataFrame, key: str = "event_id") -> DataFrame:
    """Ranks given what else the event has: agents behind legal names, generic securities behind full ones, tickers behind targets.

    Facts about a group are aggregated and joined back: two flags for each (event,
    field), and for each event the tickers that were taken for targets, with how
    often. Rows carry no list of their event; only long targets see its tickers.
    """
    t, h = F.coalesce("text", F.lit("")), F.col("field_hint")
    short = F.length(F.trim(t)) < 5
    legal, strong = is_legal_name(t) & ~is_agent(t), is_legal_name(t) | (F.length(F.trim(t)) > 12)
    groups = spans.where(h.isin(*PARTIES, "security_description")).groupBy(F.col(key).alias("__k"), h.alias("__h")).agg(F.bool_or(legal).alias("__legal"), F.bool_or(strong).alias("__strong"))
    tickers = spans.where(h == "ticker").select(F.col(key).alias("__k"), _flat(t).alias("__t")).distinct()
    lone = spans.where((h == "target") & (F.length(_flat(t)) <= 5)).groupBy(F.col(key).alias("__k"), _flat(t).alias("__t")).agg(F.count(F.lit(1)).alias("n"))
    lone = lone.join(tickers, ["__k", "__t"], "left_semi")
    listed = lone.groupBy(F.col("__k").alias("__e")).agg(F.collect_list(F.struct(F.upper("__t").alias("t"), "n")).alias("__lone"))
    out = spans.join(groups, (F.col(key) == F.col("__k")) & (h == F.col("__h")), "left").join(listed, F.when(h == "target", F.col(key)) == F.col("__e"), "left")
    as_ticker = F.coalesce(F.exists("__lone", lambda x: x["t"] == F.upper(_flat(t))), F.lit(False)) & (h == "target") & (F.length(_flat(t)) <= 5)
    party = F.when(h.isin(*PARTIES) & F.col("__legal") & (is_agent(t) | is_shell(t) | short), 0.4).otherwise(0.0)
    security = F.when((h == "security_description") & F.col("__strong") & (_flat(t).isin(*WEAK_SECURITIES) | short), 0.35).otherwise(0.0)
    passage = F.upper(F.coalesce(F.nullif("passage", F.lit("")), t))
    named = F.coalesce(F.aggregate("__lone", F.lit(0).cast("long"), lambda total, x: total + F.when(F.contains(passage, x["t"]), x["n"]).otherwise(0)), F.lit(0))
    boost = F.when((h == "target") & is_legal_name(t), 0.15 * named).otherwise(0.0)
    score = F.col("rank_score") - party - security - F.when(as_ticker, 0.3).otherwise(0.0) + boost
    return out.withColumn("rank_score", score).drop("__k", "__h", "__legal", "__strong", "__e", "__lone")


def best_spans(spans: DataFrame, n: int = 12, key: str = "event_id") -> DataFrame:
    """The best span of each normalised text, and of those the first n of each event and field."""
    order = [F.desc("rank_score"), F.col("span_id").asc()]
    one = top_per_key(spans.withColumn("__flat", _flat(F.col("text"))), [key, "field_hint", "__flat"], 1, *order)
    return top_per_key(one, [key, "field_hint"], n, *order).drop("__flat")


def weak_families(spans: DataFrame, key: str = "event_id") -> DataFrame:
    """Per event, families that have spans, of which none looks like a value. No spans isn't weak."""
    h, t = F.col("field_hint"), F.coalesce("text", F.lit(""))
    price, date, party = h == "offer_price", h.isin(*DATES[:4]), h.isin(*PARTIES)
    weak = lambda mine, good: F.coalesce(F.bool_and(F.when(mine, ~good)), F.lit(False))
    return spans.groupBy(key).agg(
        weak(price, t.rlike(MONEY)).alias("weak_price"),
        weak(date, t.rlike(CALENDAR_DATE)).alias("weak_date"),
        weak(party, ~(is_heading(t) | is_shell(t) | is_agent(t))).alias("weak_party"),
    )


def two_pass(segments: DataFrame, first: DataFrame, second: DataFrame, key: str = "event_id") -> DataFrame:
    """Spans of the first pass, and of the second where it runs: on priority segments, and on all of an event with a weak family."""
    weak = weak_families(ranked(first), key).where("weak_price or weak_date or weak_party").select(key).withColumn("__weak", F.lit(True))
    run = segments.join(weak, key, "left").where("priority or kind = 'faq' or __weak").select("segment_id")
    return first.unionByName(second.join(run, "segment_id", "left_semi"), allowMissingColumns=True)


def quality_gates(facts: DataFrame, key: str = "event_id") -> DataFrame:
    """What fails in each event's facts (field_hint, raw, rank_score, confidence, method, passage, fact_id)."""
    score = F.coalesce(F.nullif("rank_score", F.lit(0.0)), F.nullif("confidence", F.lit(0.0)), F.lit(0.0))
    top = lambda hint: F.max_by(F.when(F.col("field_hint") == hint, F.coalesce("raw", F.lit(""))), F.when(F.col("field_hint") == hint, F.struct(score, -F.col("fact_id"))))
    # The upper of the middle two lengths, without holding all.
    upper = F.expr("-percentile_disc(0.5) WITHIN GROUP (ORDER BY -nullif(length(passage), 0))").cast("int")
    one = facts.groupBy(key).agg(
        F.bool_or(F.coalesce(F.col("method") == "regex", F.lit(False))).alias("regex"), top("offer_price").alias("top1_offer_price"), top("expiration_date").alias("top1_expiration_date"),
        top("offeror").alias("top1_offeror"), top("security_description").alias("top1_security_description"), upper.alias("median"),
    )
    median = F.col("median")
    bad = lambda test, name: F.when(F.coalesce(test, F.lit(False)), F.lit(name))
    price, date, party, security = (F.col(f"top1_{c}") for c in ("offer_price", "expiration_date", "offeror", "security_description"))
    failures = F.array_compact(F.array(
        bad(F.col("regex"), "method_regex_present"), bad(~F.coalesce(price, F.lit("")).rlike(MONEY), "top1_offer_price_not_money"),
        bad(~F.coalesce(date, F.lit("")).rlike(CALENDAR_DATE), "top1_expiration_date_not_calendar"), bad(is_agent(party) | is_shell(party), "top1_offeror_is_agent_or_shell"),
        bad(_flat(security).isin(*BOILERPLATE_SECURITIES) & security.isNotNull(), "top1_security_boilerplate"), bad(median < 300, "passage_median_lt_300"),
    ))
    return one.select(key, "top1_offer_price", "top1_expiration_date", "top1_offeror", "top1_security_description", F.coalesce(median, F.lit(0)).alias("passage_len_median"), failures.alias("failures")).withColumn("ok", F.size("failures") == 0)


def top1(mentions: DataFrame, keys: list[str], score: Column | None = None) -> DataFrame:
    """The mention (value, score, pos) with the best score; the first of equals."""
    score = F.coalesce("score", F.lit(0.0)) if score is None else score
    return mentions.groupBy(*keys).agg(F.max_by(F.struct("value", "score", "pos"), F.struct(score, -F.col("pos"))).alias("m")).select(*keys, "m.*")


def consensus(mentions: DataFrame, keys: list[str], bonus: float = 0.07, threshold: float = THRESHOLD, advisory: float = 0.0, full_name: float = 0.0, generic: float = 0.0) -> DataFrame:
    """The best mention of the best value, which scores its best mention, how often it is named, and what it is called.

    Two aggregations: mentions to values, values to the answer. mentions: value,
    score, pos, and source_quote where advisory counts. full_name and generic look
    at the value's first mention.
    """
    own = F.col("score") - (F.when(F.coalesce("source_quote", F.lit("")).rlike(ADVISORY), advisory).otherwise(0.0) if advisory else F.lit(0.0))
    eligible = mentions.where(F.col("score") >= threshold).withColumn("__key", normalized(F.col("value"))).where("__key <> ''").withColumn("__own", own)
    values = eligible.groupBy(*keys, "__key").agg(
        F.max("__own").alias("__best"), F.count(F.lit(1)).alias("n_mentions"), F.min("pos").alias("__pos"),
        F.min_by(F.trim("value"), "pos").alias("__name"), F.max_by(F.struct("value", "score", "pos"), F.struct("__own", -F.col("pos"))).alias("m"),
    )
    name = F.col("__name")
    long = F.when(name.rlike(ORGANIZATION_ENDING) & (F.length(name) > 10), full_name).otherwise(0.0)
    vague = F.when((F.length(name) < 8) | F.col("__key").isin(*GENERIC_ROLES), generic).otherwise(0.0)
    total = F.col("__best") + F.lit(bonus) * F.log1p("n_mentions") + long - vague
    best = values.groupBy(*keys).agg(F.max_by(F.struct("m", "n_mentions"), F.struct(F.round(total, 9), -F.col("__pos"))).alias("b"))
    return best.select(*keys, "b.m.*", "b.n_mentions")


def assembled(mentions: DataFrame, keys: list[str], field: str = "field") -> DataFrame:
    """The answer of each field by its own rule: parties by consensus, cash only as a unit amount, the others by score."""
    of = lambda *names: mentions.where(F.col(field).isin(*names))
    acquirer = consensus(of("acquirer"), keys, 0.12, advisory=0.24, full_name=0.08, generic=0.16).drop("n_mentions")
    target = consensus(of("target"), keys, 0.12, full_name=0.08, generic=0.16).drop("n_mentions")
    unit = F.col("value").rlike(r"\$\s*\d") & ~F.col("value").rlike(r"(?i)\b(?:million|billion)\b")
    cash = top1(of("cash_consideration").where((F.col("score") >= THRESHOLD) & unit), keys)
    rest = top1(mentions.where(~F.col(field).isin("acquirer", "target", "cash_consideration")).where(F.col("score") >= THRESHOLD), keys)
    return acquirer.unionByName(target).unionByName(cash).unionByName(rest)


def gated_dates(mentions: DataFrame, keys: list[str], width: int = 110) -> DataFrame:
    """Dates with a cue of their field, and nothing that speaks against it, within ``width`` characters."""
    offset = F.col("start") - F.col("quote_start")
    low = F.greatest(F.lit(0), offset - width)
    context = F.substring("source_quote", (low + 1).cast("int"), (offset + F.length("value") + width - low).cast("int"))
    cue = F.lit(False)
    for field, pattern in DATE_CUES.items():
        cue = cue | ((F.col("field") == field) & context.rlike(pattern))
    return top1(mentions.where((F.col("score") >= THRESHOLD) & cue & ~context.rlike(NO_DATE_CONTEXT)), keys)


def near_parties(dates: DataFrame, parties: DataFrame, reach: int = 900, n: int = 3, bucket: int = 1024) -> DataFrame:
    """For each date the nearest ``n`` different party values within ``reach`` characters.

    A range join made an equi-join: both sides get the number of their stretch of
    ``bucket`` characters (which is at least ``reach``), the parties those beside it too.
    """
    d = dates.withColumn("__b", F.floor(F.col("start") / bucket))
    b = F.floor(F.col("start") / bucket)
    p = parties.select(F.col("accession").alias("__a"), F.col("value").alias("party"), F.col("start").alias("party_start"), F.explode(F.array(b - 1, b, b + 1)).alias("__pb"))
    pairs = d.join(p, (F.col("accession") == F.col("__a")) & (F.col("__b") == F.col("__pb"))).withColumn("distance", F.abs(F.col("start") - F.col("party_start"))).where(F.col("distance") <= reach)
    near = pairs.groupBy("accession", "date_id", "party").agg(F.min("distance").alias("distance"))
    return top_per_key(near, ["accession", "date_id"], n, F.col("distance"), F.col("party"))


def review_clusters(mentions: DataFrame) -> DataFrame:
    """A review row for each window of a filing, with its candidates by field (accession, window_id, field, value, score, pos, source_quote)."""
    score = F.coalesce("score", F.lit(0.0))
    ordered = lambda field: F.array_sort(F.collect_list(F.when(F.col("field") == field, F.struct((-score).alias("s"), F.col("pos"), F.col("value")))))
    listed = lambda c, n: F.array_join(F.array_distinct(F.transform(F.slice(c, 1, n), lambda x: x["value"])), " | ")
    out = mentions.groupBy("accession", "window_id").agg(ordered("acquirer").alias("a"), ordered("target").alias("t"), ordered("cash_consideration").alias("c"), F.max_by("source_quote", F.struct(score, -F.col("pos"))).alias("source_quote"))
    return out.select("accession", "window_id", F.lit("").alias("deal_id"), F.lit("").alias("review_status"), listed("a", 4).alias("acquirer_candidates"), listed("t", 4).alias("target_candidates"), listed("c", 3).alias("cash_candidates"), "source_quote")


def valid_merger_value(field: Column, value: Column, nearby: Column) -> Column:
    """Shapes of identifiers, and no par values or market prices as cash."""
    shape = F.when(field == "ticker", value.rlike(r"^[A-Z]{1,5}(?:\.[A-Z])?$")).when(field == "cusip", value.rlike("^[0-9A-Z]{9}$")).when(field == "isin", value.rlike("^[A-Z]{2}[0-9A-Z]{10}$")).otherwise(True)
    return shape & ~((field == "cash_consideration") & F.coalesce(nearby, F.lit("")).rlike(r"(?i)par\s+value|exercise\s+price|market\s+price"))
