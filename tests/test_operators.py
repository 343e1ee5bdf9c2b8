"""Behaviour of the operators on small inputs."""

from __future__ import annotations

import json
import re
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions.frames import presence
from tessera.operators import corpus as co
from tessera.operators import evaluation as ev
from tessera.operators import markup as mk
from tessera.operators import passages as ps
from tessera.operators import priority as pr
from tessera.operators import sampling as sa
from tessera.operators import spans as sp
from tessera.operators import stages as st
from tessera.sources import readers, sinks
from tessera.streaming import ingest


def values(spark, column, **columns):
    kinds = {str: "string", int: "long", float: "double"}
    df = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in columns.items()))
    return df.select(column).first()[0]


def test_hits(spark, tmp_path):
    source = {"adsh": "0001-20-000001", "form": "SC TO-T/A", "file_type": "SC TO-T/A", "file_date": "2020-02-30x", "sequence": "2", "ciks": ["0000000007"], "display_names": ["Some Co plc  (ABC, ABD)  (CIK 0000000007)"], "file_num": []}
    hits = [{"_id": "0001-20-000001:a.htm", "_source": source}, {"_id": "x:b.TXT", "_source": source | {"form": "8-K", "file_type": "EX-99.1", "ciks": None, "display_names": ["Lone"], "file_num": ["005-1", "005-2"], "file_date": "2020-02-03"}}]
    (tmp_path / "h.json").write_text("\n".join(map(json.dumps, hits)))
    a, b = co.document_table(co.records_from_hits(readers.read_hits(spark, str(tmp_path / "h.json")))).orderBy("hit_id").collect()
    assert (a.filename, a.form_family, a.tickers, a.primary_cik, a.event_id, a.doc_ext, a.format_guess) == ("a.htm", "third_party_tender", ["ABC", "ABD"], "0000000007", "NO_FILE_NUM:0001-20-000001", ".htm", "html")
    assert a.is_amendment and a.is_primary_form_doc and not a.is_exhibit and a.file_date is None and a.entity_name == "Some Co plc"
    assert (b.filename, b.event_id, b.format_guess, b.is_exhibit, b.is_primary_form_doc, b.primary_cik, b.tickers) == ("b.TXT", "005-1", "text", True, False, None, [])


DOCUMENTS = "hit_id string, event_id string, accession string, filename string, form string, file_type string, file_description string, is_primary_form_doc boolean, is_exhibit boolean, is_amendment boolean, file_date string, sequence int"


def test_cohorts(spark):
    rows = [
        ("1", "e", "a", "c.htm", "SC TO-T", "SC TO-T", "", True, False, False, "2024-01-02", 1),
        ("2", "e", "a", "o.htm", "SC TO-T", "EX-99.(A)(1)(A)", "Offer to Purchase", False, True, False, "2024-01-02", 2),
        ("3", "e", "b", "r.htm", "SC 14D9", "SC 14D9", "", True, False, False, "2024-01-03", 1),
        ("4", "f", "c", "c.htm", "SC TO-T", "SC TO-T", "", True, False, False, "2024-01-02", 1),
        ("5", "f", "d", "r.htm", "SC 14D9", "SC 14D9", "", True, False, False, "2024-01-02", 1),
        ("6", "g", "e", "x.htm", "SC TO-I", "EX-99.(A)(1)(C)", "Notice", False, True, False, "2024-01-02", 3),
        ("7", "g", "e", "y.htm", "SC TO-I", "EX-99.(A)(1)(D)", "Fee table", False, True, False, "2024-01-02", 4),
    ]
    got = {r.event_id: r for r in pr.cohorts(spark.createDataFrame(rows, DOCUMENTS)).collect()}
    assert {k: r.cohort for k, r in got.items()} == {"e": "gold", "f": "needs_otp_resolve", "g": "incomplete"}
    assert got["e"].download_ready and got["g"].otp_method == "inferred" and got["f"].otp_method is None


def test_text_functions(spark):
    assert values(spark, tx.normalized(F.col("x")), x=" A  b ") == "a b"
    assert values(spark, tx.normalized(F.col("x")), x="N/A") == ""
    assert values(spark, tx.soft_match(F.col("p"), F.col("g")), p="Acme Corp", g="the ACME corp of X")
    assert values(spark, tx.soft_match(F.col("p"), F.col("g")), p="$10.50 cash", g="10.50 per share")
    assert not values(spark, tx.soft_match(F.col("p"), F.col("g")), p="$0.01", g="$10.50")
    assert [str(values(spark, tx.date_of(F.col("x")), x=x)) for x in ("2024-05-06", "May 6, 2024", "Jan 6, 2024", "soon")] == ["2024-05-06", "2024-05-06", "2024-01-06", "None"]
    assert values(spark, tx.dates_in(F.col("x")), x="on MAY 6, 2024 and 5/7/2024 or June 31, 2024") == ["2024-05-06", "2024-05-07"]
    assert [values(spark, tx.cash_of(F.col("x")).cast("double"), x=x) for x in ("$539.22", "539.22 USD", "$1 or $2", "none")] == [539.22, 539.22, None, None]
    assert values(spark, tx.strip_wrapper(F.col("x")), x="<DOCUMENT><TYPE>X<TEXT> inner </TEXT></DOCUMENT>") == " inner "
    text = "First one. " + "x" * 30 + " here $5 is. " + "y" * 60
    at = text.index("$5")
    assert values(spark, tx.expand_passage(F.col("t"), F.lit(at), F.lit(at + 2), 45), t=text) == "x" * 30 + " here $5 is."
    ex, da, ca = ("ticker",), ("effective_date",), ("cash_consideration",)
    pairs = {("ticker", "ABC", "abc"): "match", ("ticker", "ABC", "ABD"): "mismatch", ("effective_date", "May 6, 2024", "2024-05-06"): "match", ("cash_consideration", "$539.22", "539.22 USD"): "match", ("target", "A", "B"): "needs_review"}
    for (f, p, g), want in pairs.items():
        assert values(spark, tx.compare(F.col("f"), F.col("p"), F.col("g"), F.lit(""), ex, da, ca), f=f, p=p, g=g) == want
    df = spark.createDataFrame([("The tender offer price",), (None,)], "t string")
    assert [tuple(r) for r in df.select(*presence({"a": ("(?i)tender", "price"), "b": ("x",)}, F.col("t"))).collect()] == [(True, 2, False, 0), (False, 0, False, 0)]


SPANS = "event_id string, span_id int, label string, text string, score double, doc_role string, segment_kind string, priority boolean, passage string"


def test_ranking(spark):
    rows = [
        ("e", 1, "offer_price_amount", "Offer Price", 0.95, "otp", "toc_section", False, ""),
        ("e", 2, "offer_price_amount", "$18.75", 0.70, "otp", "faq", True, ""),
        ("e", 3, "offeror_organization", "Computershare Trust Company, N.A.", 0.9, "cover", "full_doc", False, ""),
        ("e", 4, "offeror_organization", "Big Buyer Holdings, Inc.", 0.6, "cover", "full_doc", False, ""),
        ("e", 5, "offeror_organization", "big buyer  holdings, inc.", 0.5, "cover", "full_doc", False, ""),
        ("e", 6, "cusip_code", "123456789", 0.5, "otp", "full_doc", False, ""),
        ("e", 7, "cusip_code", "987654321", 0.5, "cover", "full_doc", False, ""),
    ]
    best = sp.best_spans(sp.demoted(sp.ranked(spark.createDataFrame(rows, SPANS)))).orderBy("field_hint", F.desc("rank_score")).collect()
    assert [r.span_id for r in best] == [7, 6, 2, 1, 4, 3]
    weak = sp.weak_families(sp.ranked(spark.createDataFrame(rows[:1], SPANS))).first()
    assert weak.weak_price and not weak.weak_date and not weak.weak_party
    segments = spark.createDataFrame([("e", "s1", "toc_section", False), ("f", "s2", "faq", True), ("f", "s3", "toc_section", False)], "event_id string, segment_id string, kind string, priority boolean")
    second = spark.createDataFrame([(f"s{k}", k) for k in (1, 2, 3)], "segment_id string, span_id int")
    assert {r.span_id for r in sp.two_pass(segments, spark.createDataFrame(rows[:1], SPANS), second).collect()} == {1, 2}


def test_gates(spark):
    kind = "event_id string, fact_id int, field_hint string, raw string, rank_score double, confidence double, method string, passage string"
    good = [("g", 1, "offer_price", "$18.75", 0.9, None, "rule", "x" * 400), ("g", 2, "expiration_date", "May 6, 2024", 0.9, None, "rule", "x" * 400), ("g", 3, "offeror", "Buyer, Inc.", 0.9, None, "rule", "x" * 400)]
    bad = [("b", 1, "offer_price", "Offer Price", 0.0, 0.9, "regex", "x"), ("b", 2, "offer_price", "$1", None, 0.5, "rule", "x"), ("b", 3, "offeror", "Purchaser", 0.9, None, "rule", "")]
    got = {r.event_id: r for r in sp.quality_gates(spark.createDataFrame(good + bad, kind)).collect()}
    assert got["g"].ok and got["g"].passage_len_median == 400
    assert got["b"].failures == ["method_regex_present", "top1_offer_price_not_money", "top1_expiration_date_not_calendar", "top1_offeror_is_agent_or_shell", "passage_median_lt_300"]


MENTIONS = "accession string, field string, value string, score double, pos int, source_quote string, start int, quote_start int"


def test_rerankers(spark):
    m = [
        ("a", "acquirer", "Bank Advisors Inc.", 0.80, 1, "financial advisor to", 0, 0), ("a", "acquirer", "Real Buyer Corporation", 0.70, 2, "will acquire", 0, 0), ("a", "acquirer", "Real buyer  corporation", 0.65, 3, "", 0, 0),
        ("a", "target", "Company", 0.80, 1, "", 0, 0), ("a", "target", "Long Target Name Inc.", 0.72, 2, "", 0, 0),
        ("a", "cash_consideration", "$360 million", 0.9, 1, "", 0, 0), ("a", "cash_consideration", "$10.50", 0.5, 2, "", 0, 0), ("b", "cash_consideration", "$5 billion", 0.9, 1, "", 0, 0), ("a", "ticker", "ABC", 0.3, 1, "", 0, 0),
        ("a", "effective_date", "May 6, 2024", 0.9, 1, "the agreement dated May 6, 2024 was", 20, 0), ("a", "effective_date", "June 7, 2024", 0.5, 2, "The effective time is June 7, 2024", 122, 100),
    ]
    df = spark.createDataFrame(m, MENTIONS)
    got = {(r.accession, r.field): r.value for r in sp.assembled(df, ["accession", "field"]).collect()}
    assert got[("a", "acquirer")] == "Real Buyer Corporation" and got[("a", "target")] == "Long Target Name Inc." and got[("a", "cash_consideration")] == "$10.50"
    assert ("b", "cash_consideration") not in got and ("a", "ticker") not in got
    assert [r.value for r in sp.gated_dates(df.where("field = 'effective_date'"), ["accession", "field"]).collect()] == ["June 7, 2024"]


GOLD = "accession string, reference_row_id string, deal_id string, field string, gold_state string, gold_value string, review_status string, comparison_override string"


def test_deal_scoring(spark):
    ok = "verified"
    gold = [
        ("a", "1", "d1", "ticker", "present", "ABC", ok, ""), ("a", "1", "d1", "cusip", "present", "X", ok, ""), ("a", "1", "d1", "isin", "absent", "", ok, ""), ("a", "1", "d1", "target", "unknown", "", ok, ""),
        ("a", "1", "d1", "acquirer", "present", "Foo", ok, ""), ("a", "1", "d1", "cash_consideration", "present", "$5", "open", ""), ("m", "1", "d1", "ticker", "present", "Q", ok, ""), ("m", "2", "d2", "ticker", "present", "R", ok, ""),
    ]
    predictions = [("a", "", "ticker", "abc"), ("a", "", "cusip", "Y"), ("a", "", "isin", "Z"), ("a", "", "acquirer", "Food"), ("m", "d2", "ticker", "R")]
    out = ev.deal_outcomes(spark.createDataFrame(gold, GOLD), spark.createDataFrame(predictions, "accession string, deal_id string, field string, predicted_value string"), ("ticker", "cusip", "isin"), ("effective_date",), ("cash_consideration",))
    got = {(r.accession, r.deal_id, r.field): r.outcome for r in out.collect()}
    assert [got[("a", "d1", f)] for f in ("ticker", "cusip", "isin", "target", "acquirer", "cash_consideration")] == ["tp", "mismatch", "fp", "unknown_gold", "needs_comparison_review", "not_reviewed"]
    assert got[("m", "d1", "ticker")] == "multi_deal_unaligned" and got[("m", "d2", "ticker")] == "tp"
    micro = ev.summed(out.where("accession = 'a'"), []).where("field = '(all)'").first()
    assert (micro.tp, micro.fp, micro.fn, micro.f1) == (1, 2, 1, 0.4)


def test_top1_scopes(spark):
    reference = spark.createDataFrame([(1, " a ", "target", "Acme Inc"), (2, "a", "ticker", "ABC"), (3, "z", "ticker", "Q"), (4, "a", "cusip", "N/A")], "row_id int, accession string, field string, gold string")
    predictions = spark.createDataFrame([("a", "target", "acme inc."), ("a", "ticker", "XYZ"), ("a", "cusip", "1")], "accession string, field string, value string")
    show = lambda **k: sorted((r.row_id, r.outcome) for r in ev.top1_outcomes(reference, predictions, **k).collect())
    assert show() == [(1, "tp"), (2, "mismatch"), (4, "fp")]
    assert show(scope="all") == [(1, "tp"), (2, "mismatch"), (3, "fn"), (4, "fp")]
    assert show(gold_missing_is_blank=False) == [(1, "tp"), (2, "mismatch"), (4, "mismatch")]
    with pytest.raises(ValueError):
        ev.top1_outcomes(reference, predictions, scope="some")


def test_validation(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    assert ev.unique_by(df, ["k"]).count() == 1
    with pytest.raises(PySparkException):
        ev.refuse(df, F.col("v") == "b", "bad v").collect()
    with pytest.raises(ValueError):
        ev.require_columns(df, ["k", "z"])
    cells = ev.review_cells(spark.createDataFrame([("a", "x", "y")], "accession string, target string, ticker string"), ("target", "ticker"))
    assert [(r.field, r.reference_value, r.gold_value) for r in cells.orderBy("field").collect()] == [("target", "x", ""), ("ticker", "y", "")]
    cov = ev.reference_coverage(*[spark.createDataFrame([(x,) for x in xs], "accession string") for xs in (["a", "a ", "b"], ["a"], ["a"])]).first()
    assert tuple(cov) == (3, 2, 1, 1, 1)


def make(how, text):
    return list(how(text))


def of_texts(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string")


def plain_sliding(text, size=900, overlap=150, most=8):
    """The windows by their definition: cut at the last space of the second half, step back by the overlap, then the tail."""
    out, at = [], 0
    while text.strip() and at < len(text) and len(out) < most - 1:
        end = min(at + size, len(text))
        if end < len(text) and " " in text[at + size // 2 : end]:
            end = at + size // 2 + text[at + size // 2 : end].rindex(" ")
        out.append((at, end))
        at = len(text) if end == len(text) else max(end - overlap, at + 1)
    tail = max(0, len(text) - size)
    if out and out[-1][1] < len(text) and min(abs(a - tail) for a, _ in out) >= 50:
        out.append((tail, len(text)))
    return out


def test_windows(spark):
    words = "word " * 500
    texts = ["x" * 5000, words, "é\U0001f600 " * 900, "short", "  ", "", None, "a" * 900, "a" * 901, "ab " * 4000]
    got: dict = {}
    for r in ps.windows(of_texts(spark, *texts), "id", "text", ps.sliding()).orderBy("id", "window_id").collect():
        assert r.chunk == texts[r.id][r.start : r.start + len(r.chunk)]
        got.setdefault(r.id, []).append((r.start, r.start + len(r.chunk)))
    assert got == {k: plain_sliding(t) for k, t in enumerate(texts) if t and t.strip()}
    long = "a " * 2000 + "merger agreement " + "b " * 2000 + "Merger Agreement" + " c" * 2000
    many = " ".join(f"{'z ' * 500}{w}" for w in ("merger agreement", "per share", "exchange ratio", "special meeting", "effective time", "CUSIP") * 3)
    found = ps.windows(of_texts(spark, long, " ", many), "id", "text", ps.anchored()).orderBy("id", "window_id").collect()
    assert [r.start for r in found if r.id == 0] == [0, 3820, 7837] and not [r for r in found if r.id == 1]
    assert [r.start for r in found if r.id == 2][0] == 0 and len([r for r in found if r.id == 2]) == 12
    assert all((long, " ", many)[r.id][r.start : r.start + 900] == r.chunk for r in found)


def test_occurrences_equal_finditer(spark):
    texts = ["", "ab abab ABx", "x\U0001f600ab\nab", "no", None, "ab" * 300]
    got = of_texts(spark, *texts).select("id", ps.occurrences(F.coalesce("text", F.lit("")), "(a)(b)", 1, 2).alias("m")).collect()
    for r in got:
        expected = [(m.start(), m.end(), 1, m.group(2)) for m in re.finditer("(a)(b)", texts[r.id] or "", re.I)]
        assert [tuple(x) for x in r.m] == expected


def terms(spark, text):
    return [(t["field"], t["value"], t["detection"], t["review_flags"]) for t in ps.merger_terms(of_texts(spark, text), "id", "text").collect()]


def test_merger_terms(spark):
    deal = "Under the merger agreement each share will be converted into the right to receive "
    assert terms(spark, deal + "$10.50 in cash per share.")[0][:3] == ("cash_amount", "10.50", "merger_candidate")
    assert terms(spark, "The price of a ticket is $10 per share of nothing.") == []
    assert terms(spark, "Our closing market price was $25.00 per share.") == []
    assert terms(spark, deal + "common stock, par value $0.01 per share.") == []
    assert [t[2] for t in terms(spark, "An exchange offer for senior notes under the merger agreement. Record date of May 3, 2024.")] == ["review_exchange_offer_overlap"]
    assert [t[:2] for t in terms(spark, "We completed the merger on May 3, 2024.")] == [("effective_date", "May 3, 2024")]
    assert terms(spark, "We expect to complete the merger on May 3, 2024.") == []
    assert [t[0] for t in terms(spark, "The record date for the vote is May 3, 2024.")] == ["record_date"]
    both = [t[1] for t in terms(spark, deal + "$10.50 in cash per share, or the right to receive $11 in cash per share.")]
    assert sorted(both) == ["10.50", "11"]
    mixed = terms(spark, "Merger consideration: common stock par value $0.01 per share receives $15.00 in cash per share.")
    assert "15.00" in [t[1] for t in mixed] and "0.01" not in [t[1] for t in mixed]
    assert terms(spark, deal + "$9 in cash per share, subject to a valuation.")[0][3] == ["historical_or_valuation", "conditional"]
    text = "\U0001f600 " + deal + "$1,010.50 in cash per share or the right to receive 0.75 common shares."
    found = ps.merger_terms(of_texts(spark, text, None), "id", "text").collect()
    assert sorted((t.field, t.value) for t in found) == [("cash_amount", "1010.50"), ("conversion_ratio", "0.75")]
    for t in found:
        assert text[t["value_start"] : t["value_end"]].replace(",", "") == t["value"] and text[t["evidence_start"] : t["evidence_end"]] == t["source_quote"]
    two = ps.merger_terms(of_texts(spark, "Merger consideration is $10.00 per share.\nMerger consideration is $12.00 per share."), "id", "text")
    assert [(r.field, r["values"]) for r in ps.conflicting_terms(two, "id").collect()] == [("cash_amount", ["10.00", "12.00"])]


def test_merger_passages(spark):
    texts = [
        "an Agreement and Plan of Merger, dated May 1, by and among A and B", "each outstanding share of stock", "shares of its new common stock", "you may elect to receive cash", "a non-electing holder",
        "subject to proration", "conditions to the merger", "we expect that it will close", "termination of the merger agreement", "nothing here", None,
    ]
    got: dict = {}
    for r in ps.merger_passages(of_texts(spark, *texts), "id", "text").collect():
        assert texts[r.id][r.evidence_start : r.evidence_end] == r.source_quote
        got.setdefault(r.id, []).append(r.field)
    assert [got[k][0] for k in range(9)] == list(ps.PASSAGE_RULES) and not {9, 10} & set(got)


def test_meetings_and_evidence(spark):
    text = "The special meeting will be held on March 7, 2024. Meeting of stockholders. On June 1, 2024 x"
    found = {m["iso_date"]: m for m in ps.meeting_dates(of_texts(spark, text, None, "no date"), "id", "text").collect()}
    assert found["2024-03-07"]["tier"] == "strict" and all(text[m["start"] : m["end"]] == m["value"] for m in found.values())
    texts = ["They signed a merger agreement. If they completed the merger.", None]
    assert [(m.id, m.kind) for m in ps.merger_evidence(of_texts(spark, *texts), "id", "text").collect()] == [(0, "merger_agreement_signed")]
    review = "The exchange ratio is the quotient of two numbers. " * 5 + "The effective time is unknown."
    got = ps.term_evidence(of_texts(spark, review), "id", "text").collect()
    assert [r.kind for r in got] == ["exchange_ratio_context"] * 3 and all(review[r.quote_start :].startswith(r.quote) for r in got)


def test_spans_gates(spark):
    text = "Buyer Holdings Inc. will acquire Target Works Corp. for $12.00 per share; par value $0.01. Nasdaq: TOOLONGX. CUSIP 12345678A."
    found = ps.spans(of_texts(spark, text, "", None), "id", "text").collect()
    assert all(text[s["start"] : s["end"]] == s["value"] and text[s["quote_start"] : s["quote_end"]] == s["source_quote"] for s in found)
    by = {f: [s["value"] for s in found if s["field"] == f] for f in {s["field"] for s in found}}
    assert by["cusip"] == ["12345678A"] and "Buyer Holdings Inc." in by["acquirer"] and len({(s["label"], s["start"], s["end"]) for s in found}) == len(found)
    long = ("filler words " * 90 + "merger agreement with Buyer Holdings Inc. and its owners ") * 4
    found = ps.spans(of_texts(spark, long), "id", "text").collect()
    assert len({(s.label, s.start) for s in found}) == len(found) > 2 and all(long[s.start : s.end] == s.value for s in found)


OFFER = """<DOCUMENT><TEXT><html><body><a name="toc"></a><p>Contents</p><a name="sts"></a><b>SUMMARY TERM SHEET</b><p>This is a summary of the offer with enough words in it.</p>
<a name="intro"></a><p><b>Introduction</b><p>To the holders of shares: an introduction that goes on for a while, unclosed.<table><tr><td>1<td>2</table>
<p><b>How much will you pay?</b></p><p>We will pay $18.75 per share in cash.</p><p><b>Who is buying?</b></p><p>Buyer Holdings, Inc. is buying all shares.</p>
<dl><dt>What if</dt><dd>Then that happens to you.</dd></dl><p>Q: Is it long?</p><p>A: Yes, it is quite long.</p><script>x</script></body></html></TEXT></DOCUMENT>"""


def test_segments():
    found = make(mk.segments_of("otp"), OFFER)
    kinds = [s["segment_kind"] for s in found]
    assert "priority_section" in kinds and kinds.count("faq") == 4
    faq = {s["heading"]: s["body"] for s in found if s["segment_kind"] == "faq"}
    assert "$18.75" in faq["How much will you pay?"] and faq["Is it long?"] == "Yes, it is quite long." and "Then that" in faq["What if?"]
    assert [s["segment_kind"] for s in make(mk.segments_of("cover"), OFFER)] == ["full_doc"]
    assert mk.unwrapped("<document><text> inner </text>") == " inner " and mk.unwrapped("plain") == "plain"
    assert mk.table_shape(OFFER)["n_tables"] == 1
    page = "<p>Cash of <b>$10</b>.50 per</p><ix:hidden>no</ix:hidden><div>next<br>line</div><script>x</script>"
    assert mk.block_text(page) == "Cash of $10 .50 per\nnext\nline"
    assert mk.page_text("<p>a<!-- c --> b<style>x</style></p>") == "a\nb"


def test_year_sample(spark):
    rows = [(i, 2020 + i % 2, f"e{i % 3}", f"2020-01-{i + 1:02d}") for i in range(12)]
    got = sa.diverse_by_year(spark.createDataFrame(rows, "id int, year int, who string, day string"), 5, "year", "who", ["day"]).collect()
    assert [r.year for r in got].count(2020) == 3 and len({r.id for r in got}) == 5 and len({r.who for r in got if r.year == 2020}) == 3


@pytest.mark.parametrize("seed", range(4))
def test_year_sample_equals_plain_rounds(spark, seed):
    """The choice made on all rows, quota by quota."""
    import random

    r = random.Random(seed)
    rows = [(i, r.choice([2019, 2020, 2021, None]), r.choice(["", None, *"abcdef"]), f"2020-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}-{i}", f"f{r.randint(0, 60)}") for i in range(80)]
    n = r.choice([5, 8, 30, 100])
    got = sa.diverse_by_year(spark.createDataFrame(rows, "id int, year int, who string, day string, filing string"), n, "year", "who", ["day"], "filing").collect()
    first: dict = {}
    for x in sorted((x for x in rows if x[1]), key=lambda x: x[3]):
        first.setdefault(x[4], x)
    pool = sorted(first.values(), key=lambda x: (x[1], x[3]))
    years = sorted({x[1] for x in pool})
    picked: list = []
    stages = [([x for x in pool if x[1] == y], n // len(years) + (k < n % len(years))) for k, y in enumerate(years)] + [(pool, n)]
    for k, (some, quota) in enumerate(stages):
        room = quota if k < len(years) else n - len(picked)
        for fresh in (True, False):
            for x in some:
                if room > 0 and x not in picked and not (fresh and x[2] and x[2] in {p[2] for p in picked}):
                    picked.append(x)
                    room -= 1
    assert sorted(x.id for x in got) == sorted(x[0] for x in picked)


def test_year_sample_reads_its_rows_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = spark.range(600).selectExpr("id", "cast(2019 + id % 3 as int) year", "concat('e', id % 50) who", "lpad(id, 5, '0') day").repartition(5)
    got = sa.diverse_by_year(rows.mapInArrow(counted, rows.schema), 6, "year", "who", ["day"]).collect()
    assert sorted(r.id for r in got) == [0, 1, 2, 3, 4, 5] and read.value == 600


def test_stages_resume(spark, tmp_path):
    runner = st.Runner(spark, tmp_path.as_uri(), "id")
    source = spark.createDataFrame([(i, f"t{i}") for i in range(6)], "id int, text string")
    stage = st.Stage("clean", lambda df: st.with_failures(df, "id", {"odd": F.col("id") % 2 == 1}))
    runner.run(stage, source, limit=4)
    assert sorted(r.id for r in runner.table("clean").collect()) == [0, 1, 2, 3]
    runner.run(stage, source)
    done = runner.table("clean")
    assert {r.id for r in done.where("status = 'ok'").collect()} == {0, 2, 4}
    assert done.where("status = 'ok'").count() == 3
    assert [r.id for r in st.fresh_first(source, done.where("status = 'ok'"), "id", 4).collect()] == [1, 3, 5, 0]


def test_assembly(spark):
    inventory = spark.createDataFrame([("e", "sc_14d9", "a", "x.htm"), ("e", "otp", "b", "y.htm"), ("f", "otp", "c", "z.htm")], "event_id string, role string, accession string, filename string")
    downloads = spark.createDataFrame([("a", "x.htm", "skipped"), ("b", "y.htm", "ok")], "accession string, filename string, status string")
    spans = spark.createDataFrame([("e", 1, "offer_price_amount", "$18.75", 0.7, "otp", "faq", True, "p", "rule")], SPANS + ", method string")
    reps = st.assemble(inventory, spans, downloads, "rules")
    got = {r.event_id: r for r in reps.collect()}
    assert got["e"].status == "ok" and got["e"].exceptions == [] and got["f"].status == "failed" and got["f"].exceptions == ["missing_14d9", "no_facts"]
    tables = st.rep_tables(reps, "tender")
    assert tables["facts"].first().raw == "$18.75" and tables["documents"].count() == 3
    with pytest.raises(PySparkException):
        st.rep_tables(reps, "tender", ["model"])["facts"].collect()


def fetch(form, start, end, offset, size):
    hits = [{"_id": f"{form}:{start}:{k}"} for k in range(5)]
    return len(hits), hits[offset : offset + size]


def test_sources_and_sinks(spark, tmp_path):
    spark.dataSource.register(readers.SearchSource)
    got = spark.read.format("paged_search").option("forms", "8-K,S-4").option("start", "2024-01-15").option("end", "2024-02-10").option("page_size", "2").option("fetcher", "tests.test_operators:fetch").load()
    assert got.count() == 20 and {r.window_start for r in got.collect()} == {"2024-01-15", "2024-02-01"}
    work = readers.work_list(spark, "2024-01-15", "2024-02-10", tracks=["tender", "conversion"])
    assert work.count() == 8
    done = spark.createDataFrame([("tender|SC TO-T|2024-01-15|2024-01-31",), ("SC TO-I|2024-01-15|2024-01-31",)], "key string")
    assert readers.work_list(spark, "2024-01-15", "2024-02-10", done, ["tender", "conversion"]).count() == 6
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("documents/1.json", json.dumps({"text": "hello"}))
        z.writestr("documents/2.json", json.dumps({"text": ""}))
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    rows = readers.read_archive(spark, str(tmp_path / "*.zip"), "text string").collect()
    assert sorted(r.error or "" for r in rows) == ["", "File is not a zip file", "empty text"]
    (tmp_path / "t.csv").write_text('﻿a,b\n"x\ny","say ""hi"""\n', encoding="utf-8")
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "t.csv")).collect()] == [("x\ny", 'say "hi"')]
    (tmp_path / "t.txt").write_bytes(b"<!DOCTYPE html>\xff")
    assert readers.read_texts(spark, str(tmp_path / "t.txt")).first().is_html
    missing, there = ("/no/such/path", lambda p: 1 / 0), ((tmp_path / "t.csv").as_uri(), lambda p: readers.read_csv(spark, p))
    assert readers.first_that_exists(spark, missing, there).count() == 1
    spans = spark.createDataFrame([("a", {"target": [("X", 0.5)]})], "accession string, candidates map<string,array<struct<value:string,score:double>>>")
    assert sinks.flat_spans(spans).first().value == "X"
    both = sinks.sections({"one": spans.select("accession"), "two": spans.select("candidates")})
    assert both.count() == 2 and set(both.columns) == {"accession", "candidates", "section"}
    sinks.write_report(both, str(tmp_path / "report"))
    sinks.write_partitions(both.fillna("-"), str(tmp_path / "parts"), "section")
    assert spark.read.parquet(str(tmp_path / "parts")).count() == 2


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    for copy in (1, 2):
        events.write.mode("append").parquet(str(tmp_path / "in"))
    stream = ingest.deduplicated(ingest.file_stream(spark, str(tmp_path / "in"), events.schema, 1), "event_id", "ts", "30 days")
    for _ in range(2):  # the second start finds nothing new
        ingest.run_available(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"), "event_id")
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == events.select("event_id").distinct().count() == out.select("event_id").distinct().count()


def test_partitions_do_not_matter(spark):
    from tessera.plans import surrogate

    d = surrogate.documents(spark, "/root/testdata/sf0.001").cache()
    show = lambda n: sorted(map(str, co.event_table(d.repartition(n)).select(*sorted(co.event_table(d).columns)).collect()))
    assert show(1) == show(7)


def test_offsets_take_time_in_proportion(spark):
    """A hundred thousand matches in one text, with their surroundings, and merger terms as many as fit: no step looks at all the others."""
    import time

    from tessera.operators import passages as ps

    def seconds(make, n: int) -> float:
        df = spark.createDataFrame([(1, make(n))], "id long, text string")
        began = time.perf_counter()
        total = ps.find_all(df, "id", "text", {"m": r"\$\d+\.\d+"}, 10, 10).selectExpr("count(*) as n", "max(end) as e", "sum(length(quote)) as q").first()
        assert total["n"] == n and total["e"] == len(make(n).rstrip())
        return time.perf_counter() - began

    amounts = lambda n: " ".join(f"the ${k}.50" for k in range(n))
    seconds(amounts, 1000)
    assert seconds(amounts, 100_000) < 10

    terms = lambda n: "The merger agreement. " + " ".join(f"Each share converted into ${k}.50 in cash per share." for k in range(n))
    df = spark.createDataFrame([(1, terms(8000))], "id long, text string")
    began = time.perf_counter()
    assert ps.merger_terms(df, "id", "text").where("field = 'cash_amount'").count() == 8000
    assert time.perf_counter() - began < 20


def test_scans_and_parts(spark):
    from pyspark.sql import functions as F

    from tessera.functions import arrays as ar

    rows = [([],), ([5],), ([1, 2],), ([3, -1, 4, 1, 5, 9, 2, 6, 5],), (list(range(1000)),)]
    got = spark.createDataFrame(rows, "a array<int>").select("a", ar.prefix_sums(F.col("a")).alias("s"), ar.scan(F.col("a"), F.greatest).alias("m")).collect()
    for r in got:
        assert r["s"] == [sum(r["a"][: i + 1]) for i in range(len(r["a"]))]
        assert r["m"] == [max(r["a"][: i + 1]) for i in range(len(r["a"]))]
    text = "".join(chr(97 + i % 26) + ("日𝒳" if i % 7 == 0 else "\n") for i in range(900))
    spans = [(0, 0), (0, 5), (510, 4), (512, 512), (1000, 2000), (len(text) - 1, 9), (len(text) + 3, 4), (-3, 5), (-9, 4)]
    df = spark.createDataFrame([(text, a, n) for a, n in spans], "t string, a int, n int")
    for r in df.select("a", "n", ar.part(ar.blocks(F.col("t")), F.col("a"), F.col("n")).alias("p")).collect():
        assert r["p"] == text[max(0, r["a"]) : max(0, r["a"] + r["n"])]


def test_first_of_equals(spark):
    from pyspark.sql import functions as F

    from tessera.operators.passages import first_of_equals

    df = spark.createDataFrame([([(1, "a"), (2, "b"), (1, "c"), (1, "d"), (2, "e")],), ([],)], "v array<struct<k:int,x:string>>")
    kept = lambda last: [[x["x"] for x in r[0]] for r in df.select(first_of_equals(F.col("v"), lambda s: [s["k"]], last)).collect()]
    assert kept(False) == [["a", "b"], []] and kept(True) == [["d", "e"], []]


def test_runs_that_are_taken_up(spark):
    from tessera.operators import evaluation as ev
    from tessera.operators import selection as se

    selected = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "accession string, pos int")
    done = spark.createDataFrame([("a", 1, "m"), ("b", 2, "m")], "accession string, pos int, model string")
    assert sorted(r["accession"] for r in se.refuse_other_run(done, selected, "m").collect()) == ["a", "b"]
    for bad in ([("b", 1, "m")], [("a", 1, "other")], [("a", 9, "m")], [("a", 1, None)]):
        with pytest.raises(Exception, match="another input or model"):
            se.refuse_other_run(spark.createDataFrame(bad, done.schema), selected, "m").collect()
    assert ev.require_columns(done, ["pos"]) is done
    with pytest.raises(ValueError, match="missing columns: x, y"):
        ev.require_columns(done, ["x", "pos", "y"])


def test_names_and_subsets(spark, tmp_path):
    from tessera.functions import text as tx
    from tessera.operators import mvp
    from tessera.operators import selection as se
    from pyspark.sql import functions as F

    names = spark.createDataFrame([("1", "a/b/c.htm"), ("2", "c.htm"), ("3", None), ("4", "d/")], "a string, f string").select(tx.safe_name(F.col("a"), F.col("f"))).collect()
    assert [r[0] for r in names] == ["1__c.htm", "2__c.htm", None, "4__d"]
    docs = spark.createDataFrame([("SC TO-T",), ("SC 14D9/A",), ("S-4",), (None,)], "form string")
    se.write_with_subset(docs, str(tmp_path / "all"), str(tmp_path / "some"))
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "some")).collect()) == ["SC 14D9/A", "SC TO-T"]
    tagged = spark.createDataFrame([("e", True)], "event_id string, in_preferred boolean")
    tagged.write.parquet(str(tmp_path / "tagged"))
    assert mvp.load_tagged(spark, str(tmp_path / "tagged")).columns == ["event_id", "in_preferred"]


@pytest.mark.parametrize("unit", ["<p>plain", "<table><tr><td>x", "<dt>t", "<b>", "<b>Why?</b>", "<script>", "<p>q: x", "<DOCUMENT>", "<div>", "<a name='x'>y", "<li><b>z?</b>"])
def test_markup_takes_time_in_proportion(unit):
    import time

    from tessera.operators import markup as mk

    def seconds(n: int) -> float:
        page = "<html><body>" + unit * n + "<p>the end of it all"
        began = time.perf_counter()
        list(mk.segments_of("otp")(page))
        root = mk.Tree(page).root
        mk.block_text(root), mk.page_text(root), mk.table_shape(root)
        return time.perf_counter() - began

    seconds(100)
    few = seconds(8000)
    assert seconds(16_000) < 3 * few + 1
