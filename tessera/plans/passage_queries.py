"""Passage, window, span and merger-term queries, whose oracles find the same places by split and match."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import EVIDENCE_PATTERNS, WINDOW_ANCHORS
from ..functions.text import LONG_MONTHS
from ..operators import passages as ps
from ..operators import reports as rp
from ..registry import query
from .surrogate import table


def _quoted(pattern: str) -> str:
    return "'" + ("(?i)" + pattern).replace("'", "''") + "'"


def places(kind: str, pattern: str, value: str | None = None, table_: str = "t", number: int = 1) -> str:
    """A DuckDB SELECT of all matches: id, kind, number, s (offset), m (the match), and v, vs (a value's text and offset)."""
    p = _quoted(pattern)
    lead, val = (f"regexp_extract_all(text, {p}, 1)", f"regexp_extract_all(text, {p}, 2)") if value else ("NULL", f"regexp_extract_all(text, {p})")
    lists = f"SELECT id, text, regexp_extract_all(text, {p}) AS ms, string_split_regex(text, {p}) AS gaps, {lead} AS leads, {val} AS vals FROM {table_}"
    each = f"SELECT id, text, ms, gaps, leads, vals, unnest(range(1, len(ms) + 1)) AS k FROM ({lists})"
    start = "CAST(coalesce(list_sum(list_transform(gaps[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:k-1], lambda x: length(x))), 0) AS BIGINT)"
    return f"SELECT id, text, '{kind}' AS kind, {number} AS number, {start} AS s, ms[k] AS m, vals[k] AS v, {start} + coalesce(length(leads[k]), 0) AS vs FROM ({each})"


def _docs(spark: SparkSession, sf_dir: str, before: str = "", after: str = "") -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit(before), F.coalesce("text", F.lit("")), F.lit(after)).alias("text"))


def _sql_docs(before: str = "", after: str = "") -> str:
    return f"t AS (SELECT doc_id AS id, '{before}' || coalesce(text, '') || '{after}' AS text FROM documents)"


_PLAIN = {"license": r"licen[sc]ed? under [^.\n]{1,60}", "number": r"\b[0-9]{4,}\b"}
_AROUND = "substr(text, greatest(0, s - {b}) + 1, s + length(m) + {a} - greatest(0, s - {b}))"


def _found(patterns: dict[str, str]) -> str:
    return " UNION ALL ".join(places(k, p) for k, p in patterns.items())


def _match_columns(before: int, after: int) -> str:
    return f"id, kind, s AS start, s + length(m) AS \"end\", m AS value, {_AROUND.format(b=before, a=after)} AS quote, greatest(0, s - {before}) AS quote_start"


def longs(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])


@query("find_all_offsets", f"WITH {_sql_docs()}, found AS ({_found(_PLAIN)}) SELECT {_match_columns(40, 60)} FROM found")
def find_all_offsets(spark, sf_dir):
    return longs(ps.find_all(_docs(spark, sf_dir), "id", "text", _PLAIN, 40, 60))


_SAID = ("They signed the merger agreement. If it may have completed the merger. ", " It has completed the merger.")


@query(
    "merger_evidence",
    f"WITH {_sql_docs(*_SAID)}, found AS ({_found(EVIDENCE_PATTERNS)}) SELECT {_match_columns(260, 650)} FROM found"
    " WHERE NOT regexp_matches(substr(text, greatest(1, s - 179), least(s, 180)), '(?i)\\b(if|unless|may|could|would|will|shall)\\b[^.;]{0,70}$')",
)
def merger_evidence(spark, sf_dir):
    return longs(ps.merger_evidence(_docs(spark, sf_dir, *_SAID), "id", "text"))


_REVIEW = ("The exchange ratio is the quotient of two prices. The effective time is upon filing. ", " Exchange ratio unknown. The exchange ratio, divided by two, is the exchange ratio.")


@query(
    "term_evidence",
    f"WITH {_sql_docs(*_REVIEW)}, found AS ({_found(ps.REVIEW_TERMS)}), kept AS (SELECT {_match_columns(180, 270)} FROM found), good AS (SELECT * FROM kept WHERE "
    + " OR ".join(f"(kind = '{k}' AND regexp_matches(quote, {_quoted(p)}))" for k, p in ps.REVIEW_NEEDS.items())
    + ") SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY id, kind ORDER BY start) <= 3",
)
def term_evidence(spark, sf_dir):
    return longs(ps.term_evidence(_docs(spark, sf_dir, *_REVIEW), "id", "text"))


@query(
    "sliding_windows",
    f"""WITH RECURSIVE {_sql_docs()}, n AS (SELECT id, text, length(text) AS n FROM t WHERE regexp_matches(text, '\\S')),
    w AS (SELECT id, 0 AS k, 0 AS s, CASE WHEN n > 900 AND back > 0 THEN 900 - back ELSE least(900, n) END AS e FROM (SELECT id, n, instr(reverse(substr(text, 451, least(900, n) - 450)), ' ') AS back FROM n)),
    steps AS (SELECT id, k, s, e FROM w
      UNION ALL SELECT id, k + 1, pos, CASE WHEN lim < n AND back > 0 THEN lim - back ELSE lim END FROM (
        SELECT n.id, k, pos, n, least(pos + 900, n) AS lim, instr(reverse(substr(text, pos + 451, least(pos + 900, n) - pos - 450)), ' ') AS back
        FROM (SELECT id, k, greatest(e - 150, s + 1) AS pos, e FROM steps) p JOIN n ON n.id = p.id AND p.e < n.n)
    ), ends AS (SELECT id, max(k) AS k, max(e) AS e, min(abs(s - greatest(length(text) - 900, 0))) AS near FROM steps JOIN n USING (id) GROUP BY id),
    spans AS (SELECT id, k, s, e FROM steps UNION ALL SELECT id, k + 1, greatest(n - 900, 0), n FROM ends JOIN n USING (id) WHERE e < n AND near >= 50)
    SELECT id, CAST(k AS BIGINT) AS window_id, CAST(s AS BIGINT) AS start, substr(text, s + 1, e - s) AS chunk FROM spans JOIN n USING (id)""",
)
def sliding_windows(spark, sf_dir):
    """All windows of each text, up to its end."""
    return longs(ps.windows(_docs(spark, sf_dir), "id", "text", ps.sliding(most=None)))


_FIRST_LAST = ", ".join(f"CASE WHEN regexp_matches(text, {_quoted(p)}) THEN [length(string_split_regex(text, {_quoted(p)})[1]), length(text) - length(string_split_regex(text, {_quoted(p)})[-1]) - length(regexp_extract_all(text, {_quoted(p)})[-1])] ELSE [] END" for p in WINDOW_ANCHORS)
_ANCHORED = ("Merger agreement. ", " Each right to receive a per share amount at the effective time.")


_WINDOWS_SQL = f"""m AS (SELECT id, text, length(text) AS n, flatten([{_FIRST_LAST}]) AS p FROM t WHERE regexp_matches(text, '\\S')),
    r(id, k, starts) AS (SELECT id, 0, [CAST(0 AS BIGINT)] FROM m
      UNION ALL SELECT id, k + 1, CASE WHEN len(starts) < 12 AND NOT list_contains(starts, a) AND len(list_filter(starts, lambda x: x <= place AND place < x + 750)) = 0 THEN list_append(starts, a) ELSE starts END
      FROM (SELECT r.id, k, starts, p[k + 1] AS place, greatest(0, least(p[k + 1] - 180, n - 900)) AS a FROM r JOIN m ON r.id = m.id AND k < len(p))),
    last AS (SELECT id, starts FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY k DESC) = 1), o AS (SELECT id, starts, unnest(range(0, len(starts))) AS k FROM last),
    win AS (SELECT id, k, starts[k + 1] AS w0, substr(text, starts[k + 1] + 1, 900) AS c FROM o JOIN m USING (id))"""


@query("anchor_windows", f"WITH RECURSIVE {_sql_docs(*_ANCHORED)}, {_WINDOWS_SQL} SELECT id, CAST(k AS BIGINT) AS window_id, CAST(w0 AS BIGINT) AS start, c AS chunk FROM win")
def anchor_windows(spark, sf_dir):
    return longs(ps.windows(_docs(spark, sf_dir, *_ANCHORED), "id", "text", ps.anchored()))


def _in_windows(spans: list[tuple[str, str, str, str]]) -> str:
    """DuckDB SELECT of the places of (label, field, pattern, score) in all windows, each place of a label once, of its first window."""
    of = [f"SELECT id // 100 AS id, id % 100 AS k, '{label}' AS label, '{field}' AS field, {score} AS score, s, m FROM ({places(field, pattern, table_='(SELECT id * 100 + k AS id, c AS text FROM win)').replace('(?i)', '')})" for label, field, pattern, score in spans]
    return f"""hits AS (SELECT f.*, w0 + s AS s0 FROM ({" UNION ALL ".join(of)}) f JOIN win USING (id, k)),
    once AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY id, label, s0, length(m) ORDER BY k) = 1)"""


_CAPITAL, _CODE = r"\b[A-Z][a-z]{3,}\b", r"\b[0-9]{9}\b"


@query(
    "span_pipeline",
    f"""WITH RECURSIVE {_sql_docs(*_ANCHORED)}, {_WINDOWS_SQL}, {_in_windows([("acquirer organization", "acquirer", _CAPITAL, "0.6"), ("CUSIP identifier", "cusip", _CODE, "0.8")])}
    SELECT id, field, m AS value, CAST(score AS DOUBLE) AS score, CAST(s0 AS BIGINT) AS start, CAST(s0 + length(m) AS BIGINT) AS "end", substr(text, greatest(0, s0 - 220) + 1, s0 + length(m) + 220 - greatest(0, s0 - 220)) AS source_quote,
      CAST(greatest(0, s0 - 220) AS BIGINT) AS quote_start, CAST(least(length(text), s0 + length(m) + 220) AS BIGINT) AS quote_end, CAST(k AS BIGINT) AS window_id FROM once JOIN (SELECT id, text FROM t) USING (id)""",
)
def span_pipeline(spark, sf_dir):
    """A backend of two patterns in all anchored windows, up to twelve a text."""
    backend = ps.RuleBackend({"acquirer organization": (("(?a)" + _CAPITAL, 0.6),), "CUSIP identifier": (("(?a)" + _CODE, 0.8),)})  # word ends as the oracle's
    return longs(ps.spans(_docs(spark, sf_dir, *_ANCHORED), "id", "text", backend).drop("label", "method"))


_RULED = ("Under the merger agreement Buyer Holdings Inc. will acquire Target Works Corp. for $12.50 per share. ", " CUSIP 12345678A.")


@query("spans_of_all_windows")
def spans_of_all_windows(spark, sf_dir):
    """The rule backend in all sliding windows of merger texts, so that no part of a text is left out; tested against a plain version."""
    return ps.spans(_docs(spark, sf_dir, *_RULED), "id", "text", how=ps.sliding(most=None)).drop("label")


_DEAL = ("Under the merger agreement each share of this has the right to receive $", ".50 in cash per share. The record date is May 3, 2024. ")
_DEAL_SQL = f"t AS (SELECT doc_id AS id, '{_DEAL[0]}' || n_chars || '{_DEAL[1]}' || coalesce(text, '') AS text FROM documents)"


def _rules() -> str:
    return " UNION ALL ".join(places(field, pattern, "value", number=number) for field, number, pattern in ps._term_rules())


_FRONT = "regexp_matches(substr(text, 1, 18000), '(?i)exchange offer') AND regexp_matches(substr(text, 1, 18000), '(?i)(senior|subordinated) notes')"
_TERMS_SQL = f"""found AS ({_rules()}), seen AS (SELECT *, kind IN ('cash_amount', 'conversion_ratio') AS amount, {_AROUND.format(b=450, a=450)} AS quote,
      CASE WHEN {_FRONT} THEN 'review_exchange_offer_overlap' WHEN regexp_matches(text, {_quoted(ps.MERGER_CUE)}) THEN 'merger_candidate' ELSE 'review_no_strong_merger_cue' END AS detection FROM found),
    gated AS (SELECT *, regexp_matches(quote, {_quoted(ps.LOCAL_CUE)}) AS local FROM seen),
    good AS (SELECT * FROM gated WHERE NOT amount OR (local AND detection = 'merger_candidate' AND (kind <> 'cash_amount' OR (regexp_matches(quote, {_quoted(ps.PER_UNIT)}) AND NOT regexp_matches(substr(text, greatest(1, s - 39), least(s, 40)), {_quoted(ps.PAR_VALUE)}))))),
    one AS (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY id, kind, vs, length(v) ORDER BY number DESC) = 1),
    risky AS (SELECT *, list_filter([{", ".join(f"CASE WHEN regexp_matches(quote, {_quoted(p)}) THEN '{k}' END" for k, p in ps.RISKS.items())}], lambda x: x IS NOT NULL) AS flags FROM one),
    terms AS (SELECT id, detection, kind AS field, CASE WHEN amount THEN replace(v, ',', '') ELSE v END AS value, vs AS value_start, vs + length(v) AS value_end, greatest(0, s - 450) AS evidence_start,
      least(length(text), s + length(m) + 450) AS evidence_end, quote AS source_quote, kind || '_' || number AS rule, array_to_string(flags, '|') AS review_flags, CASE WHEN local AND len(flags) = 0 THEN 2 ELSE 1 END AS rank FROM risky)"""


def deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.concat(F.lit(_DEAL[0]), F.col("n_chars").cast("string"), F.lit(_DEAL[1]), F.coalesce("text", F.lit(""))).alias("text"))


@query("merger_terms", f"WITH {_DEAL_SQL}, {_TERMS_SQL} SELECT * FROM terms")
def merger_terms(spark, sf_dir):
    return longs(ps.merger_terms(deals(spark, sf_dir), "id", "text").withColumn("review_flags", F.array_join("review_flags", "|")))


@query("merger_conflicts", f"WITH {_DEAL_SQL}, {_TERMS_SQL} SELECT id % 100 AS id, field, array_to_string(list_sort(list_distinct(list(value))), '|') AS values_ FROM terms GROUP BY ALL HAVING count(DISTINCT value) > 1")
def merger_conflicts(spark, sf_dir):
    terms = ps.merger_terms(deals(spark, sf_dir), "id", "text").withColumn("id", F.col("id") % 100)
    return ps.conflicting_terms(terms, "id").select("id", "field", F.array_join("values", "|").alias("values_"))


@query("method_comparison", f"WITH {_DEAL_SQL}, {_TERMS_SQL}, k AS (SELECT id, count(*) AS n FROM terms WHERE field = 'cash_amount' GROUP BY id) SELECT id, CAST(len(regexp_extract_all(text, '[$]\\s*[0-9]')) AS BIGINT) AS n_mentions, coalesce(n, 0) AS n_candidates FROM t LEFT JOIN k USING (id)")
def method_comparison(spark, sf_dir):
    d = deals(spark, sf_dir)
    return rp.method_comparison(d, "id", "text", ps.merger_terms(d, "id", "text"))


_SPOKEN = ("We expect that the merger will close. Agreement and plan of merger between A and B. ", " If you do not elect, proration of shares of common stock; conditions to closing.")


@query(
    "merger_passages",
    f"WITH {_sql_docs(*_SPOKEN)}, found AS ({_found(ps.PASSAGE_RULES)}), q AS (SELECT *, {_AROUND.format(b=450, a=450)} AS quote FROM found) SELECT id, kind AS field, s AS start, s + length(m) AS \"end\", greatest(0, s - 450) AS evidence_start, greatest(0, s - 450) + length(quote) AS evidence_end, quote AS source_quote FROM q",
)
def merger_passages(spark, sf_dir):
    return longs(ps.merger_passages(_docs(spark, sf_dir, *_SPOKEN), "id", "text").drop("status"))


_MEETINGS = ("A shareholders meeting is on June 1, 2024; perhaps. ", " The special meeting will be held on March 7, 2024 at noon. A stockholders meeting of April 9, 2025")
_DATE = rf"\b({LONG_MONTHS})\s+[0-9]{{1,2}},?\s+20[0-9]{{2}}\b|\b[0-9]{{1,2}}/[0-9]{{1,2}}/20[0-9]{{2}}\b"


@query(
    "meeting_dates",
    f"""WITH {_sql_docs(*_MEETINGS)}, c AS ({places("c", ps.MEETING)}), d AS ({places("d", _DATE)}),
    p AS (SELECT c.id, c.s AS c0, c.s + length(c.m) AS c1, d.s AS d0, d.s + length(d.m) AS d1, d.m AS value, c.text,
      strftime(coalesce(try_strptime(regexp_replace(d.m, '\\s+', ' ', 'g'), '%B %d, %Y'), try_strptime(regexp_replace(d.m, '\\s+', ' ', 'g'), '%B %d %Y'), try_strptime(d.m, '%m/%d/%Y')), '%Y-%m-%d') AS iso_date
      FROM c JOIN d ON c.id = d.id AND d.s >= c.s - 80 AND d.s + length(d.m) <= c.s + length(c.m) + 80),
    b AS (SELECT *, substr(text, least(c1, d1) + 1, greatest(greatest(c0, d0) - least(c1, d1), 0)) AS between_ FROM p WHERE iso_date IS NOT NULL),
    s AS (SELECT *, regexp_matches(between_, {_quoted(ps.FIRM)}) AND NOT regexp_matches(between_, '[.;]') AS strict, least(abs(d0 - c1), abs(c0 - d0)) AS distance FROM b WHERE regexp_matches(between_, {_quoted(ps.LINK)}))
    SELECT id, iso_date, value, d0 AS start, d1 AS "end", distance, CASE WHEN strict THEN 'strict' ELSE 'broad' END AS tier FROM s QUALIFY row_number() OVER (PARTITION BY id, iso_date ORDER BY strict DESC, distance, c0, d0) = 1""",
)
def meeting_dates(spark, sf_dir):
    return longs(ps.meeting_dates(_docs(spark, sf_dir, *_MEETINGS), "id", "text"))

