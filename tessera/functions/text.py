"""Text, date and money expressions, all as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of a missing value.
MISSING = ("", "n/a", "na", "none", "null", "-", "—")

# Shapes of amounts, dates, identifiers and company names.
MONTHS = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
MONEY = r"(?i)\$\s*[\d,]+(?:\.\d+)?|\b\d+(?:\.\d+)?\s*(?:per\s+share|/share)\b"
CALENDAR_DATE = rf"(?i)\b(?:{MONTHS})\.?\s+\d{{1,2}},?\s+\d{{4}}\b|\b\d{{1,2}}/\d{{1,2}}/\d{{2,4}}\b|\b\d{{4}}-\d{{2}}-\d{{2}}\b"
LONG_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
TEXT_DATE = rf"(?i)\b(?:{LONG_MONTHS})\s+\d{{1,2}},?\s+20\d{{2}}\b|\b\d{{1,2}}/\d{{1,2}}/20\d{{2}}\b"
CUSIP = r"^[0-9A-Za-z]{9}$"
TICKER = r"^[A-Z]{1,5}(?:\.[A-Z])?$"
COMPANY_ENDING = r"(?i)\b(?:inc\.?|corp\.?|corporation|ltd\.?|llc|l\.?p\.?|plc|n\.?a\.?|company|co\.?)\b"


def spaces(value: Column) -> Column:
    """Runs of white space, no-break space included, as one space; none at the ends."""
    return F.trim(F.regexp_replace(value, r"[\s\p{Z}]+", " "))


def normalized(value: Column) -> Column:
    """Lower case, single spaces; a missing value, however it is spelt, is empty."""
    flat = F.lower(spaces(F.coalesce(value.cast("string"), F.lit(""))))
    return F.when(flat.isin(*MISSING), F.lit("")).otherwise(flat)


def alphanumeric(value: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "[^a-z0-9]+", "")


def blank_to_null(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def first_or_null(values: Column) -> Column:
    return F.get(values, F.lit(0))


def display_name_parts(raw: Column) -> Column:
    """struct(entity_name, tickers, cik) of names like ``Some Company plc  (ABC, ABD)  (CIK 0000000001)``."""
    name = blank_to_null(F.get(F.split(raw, r"\s+\(", 2), F.lit(0)))
    inside = F.regexp_extract(raw, r"\(([^)]+)\)\s+\(CIK", 1)
    tickers = F.filter(F.transform(F.split(F.coalesce(inside, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.struct(name.alias("entity_name"), tickers.alias("tickers"), blank_to_null(F.regexp_extract(raw, r"\(CIK\s+(\d+)\)", 1)).alias("cik"))


def filename_of_hit(hit_id: Column, accession: Column) -> Column:
    """What follows ``accession:``, or else the first colon; null without one."""
    own = F.concat(F.coalesce(accession, F.lit("")), F.lit(":"))
    colon = F.instr(hit_id, ":")
    after = F.when(hit_id.startswith(own), F.substring(hit_id, F.length(own) + 1, F.length(hit_id)))
    return after.otherwise(F.when(colon > 0, F.substring(hit_id, colon + 1, F.length(hit_id))))


def document_url(base: str, cik: Column, accession: Column, filename: Column) -> Column:
    return F.concat(F.lit(f"{base}/"), cik.cast("bigint").cast("string"), F.lit("/"), F.replace(accession, F.lit("-"), F.lit("")), F.lit("/"), filename)


def filing_index_url(base: str, cik: Column, accession: Column) -> Column:
    return document_url(base, cik, accession, F.lit("index.json"))


def soft_match(predicted: Column, gold: Column) -> Column:
    """Equal, contained (five characters or more), or with a common number where an amount is meant."""
    p, g = normalized(predicted), normalized(gold)
    numbers = lambda c: F.regexp_extract_all(c, F.lit(r"\d+(?:\.\d+)?"), F.lit(0))
    money = F.contains(p, F.lit("$")) | F.contains(g, F.lit("$")) | F.contains(p, F.lit("per share")) | F.contains(g, F.lit("per share"))
    close = (p == g) | ((F.length(p) >= 5) & F.contains(g, p)) | ((F.length(g) >= 5) & F.contains(p, g)) | (money & F.arrays_overlap(numbers(p), numbers(g)))
    return (p != "") & (g != "") & close


def string_agreement(reference: Column, candidates: Column) -> Column:
    """'exact_normalized', 'subphrase' (eight characters and three fifths) or null, of the best of an array of candidates."""
    r = alphanumeric(reference)
    keys = F.transform(candidates, lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", ""))
    part = lambda k: (F.least(F.length(k), F.length(r)) >= 8) & (F.least(F.length(k), F.length(r)) >= 0.6 * F.greatest(F.length(k), F.length(r))) & (F.contains(k, r) | F.contains(r, k))
    return F.when(r == "", F.lit(None)).when(F.exists(keys, lambda k: k == r), "exact_normalized").when(F.exists(keys, part), "subphrase")


def date_of(value: Column) -> Column:
    """A date written as 2024-01-31, January 31, 2024 or Jan 31, 2024; else null."""
    clean = F.trim(value)
    return F.coalesce(*[F.try_to_date(clean, f) for f in ("yyyy-MM-dd", "MMMM d, yyyy", "MMM d, yyyy")])


def dates_in(value: Column) -> Column:
    """The distinct ISO dates that a text names, sorted."""
    read = lambda x: F.coalesce(*[F.try_to_date(x, f) for f in ("MMMM d, yyyy", "MMMM d yyyy", "M/d/yyyy")]).cast("string")
    found = F.regexp_extract_all(value, F.lit(TEXT_DATE), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, lambda x: read(F.initcap(spaces(x)))), lambda x: x.isNotNull())))


def cash_of(value: Column) -> Column:
    """The one amount that a text names, as a decimal; null for none or several."""
    signed = F.regexp_extract_all(value, F.lit(r"\$\s*([\d,]+(?:\.\d+)?)"), F.lit(1))
    plain = F.regexp_extract_all(value, F.lit(r"(?<![A-Za-z\d])([\d,]+(?:\.\d+)?)(?![A-Za-z\d])"), F.lit(1))
    found = F.when(F.size(signed) > 0, signed).otherwise(plain)
    return F.when(F.size(found) == 1, F.replace(first_or_null(found), F.lit(","), F.lit("")).try_cast("decimal(38,10)"))


def compare(field: Column, predicted: Column, gold: Column, override: Column, exact: tuple[str, ...], dates: tuple[str, ...], cash: tuple[str, ...]) -> Column:
    """'match', 'mismatch' or 'needs_review', by the kind of field; an override decides."""
    review = F.lit("needs_review")
    same = lambda f: F.when(F.coalesce(f(predicted) == f(gold), F.lit(False)), "match").otherwise(review)
    return (
        F.when(F.coalesce(override, F.lit("")) != "", override)
        .when(alphanumeric(predicted) == alphanumeric(gold), "match")
        .when(field.isin(*exact), "mismatch")
        .when(field.isin(*dates), same(date_of))
        .when(field.isin(*cash), same(cash_of))
        .otherwise(review)
    )


def around(text: Column, start: Column, end: Column, before: int, after: int) -> Column:
    """The text from ``before`` characters before start to ``after`` after end (code points, from 0)."""
    low = F.greatest(F.lit(0), start - before)
    return F.substring(text, (low + 1).cast("int"), (end + after - low).cast("int"))


def expand_passage(text: Column, start: Column, end: Column, radius: int = 400) -> Column:
    """The surroundings of a span, cut at sentence ends where there are some within ``radius``."""
    left, right = F.greatest(F.lit(0), start - radius).cast("int"), F.least(F.length(text), end + radius).cast("int")
    head, tail = F.substring(text, left + 1, (start - left).cast("int")), F.substring(text, (end + 1).cast("int"), (right - end).cast("int"))
    marks = (". ", ".\n", "\n\n")

    def after_last(mark: str) -> Column:
        at = F.instr(F.reverse(head), mark[::-1])
        return F.when(at > 0, F.length(head) - at + 1)

    skip = F.when(left > 0, F.coalesce(*[after_last(m) for m in marks], F.lit(0))).otherwise(F.lit(0))
    keep = F.when(right < F.length(text), F.coalesce(*[F.nullif(F.instr(tail, m), F.lit(0)) for m in marks], F.length(tail))).otherwise(F.length(tail))
    whole = F.substring(text, (left + skip + 1).cast("int"), ((end - left) - skip + keep).cast("int"))
    return F.when(F.coalesce(text, F.lit("")) == "", "").otherwise(F.regexp_replace(whole, r"^\s+|\s+$", ""))


def safe_name(accession: Column, filename: Column, suffix: str = "") -> Column:
    """A file name without folders that is unique within an event."""
    bare = F.element_at(F.split(F.regexp_replace(filename, "/+$", ""), "/"), -1)
    return F.concat(accession, F.lit("__"), bare, F.lit(suffix))


def strip_wrapper(raw: Column) -> Column:
    """What stands in the first <DOCUMENT>'s <TEXT>, or the whole without one."""
    return F.coalesce(F.nullif(F.regexp_extract(raw, r"(?is)<DOCUMENT>.*?<TEXT>(.*?)</TEXT>", 1), F.lit("")), raw)


def parity_cohort(key: Column) -> Column:
    """'development' or 'comparison', by the last bit of the key's SHA-256."""
    return F.when(F.conv(F.right(F.sha2(key, 256), F.lit(1)), 16, 10).cast("int") % 2 == 0, "development").otherwise("comparison")


def text_measures(text: Column) -> list[Column]:
    """Words, characters, bytes, pages of 500 words and SHA-1."""
    words = F.regexp_count(text, F.lit(r"\S+"))
    return [words.cast("long").alias("n_words"), F.length(text).cast("long").alias("n_chars"), F.octet_length(text).cast("long").alias("n_bytes"), F.round(words / 500, 2).alias("pages"), F.sha1(F.encode(text, "UTF-8")).alias("sha1")]
