"""Windows of texts: places as by plain loops, and how often they scan the text."""

from __future__ import annotations

import random
import re

from tessera import registry
from tessera.catalog import WINDOW_ANCHORS
from tessera.operators import passages as ps
from tessera.plans import passage_queries as plans


def texts() -> dict[int, str]:
    draw = random.Random(5)
    words = ["Merger agreement", "PER SHARE", "isin", "effective time", "stock cash election", "Kelvin", "İstanbul", "café", "\U0001f600", "x" * 60, "or", "a", "special meeting\n", "CUSIP"]
    return {k: draw.choice(" \n").join(draw.choice(words) for _ in range(draw.choice([1, 20, 200, 1500]))) for k in range(40)} | {100: "", 101: " \n", 102: "y" * 5000, 103: " ".join("z" * 5000)}


def plain_anchored(text: str) -> list[int]:
    starts = [0]
    for anchor in WINDOW_ANCHORS:
        found = [m.start() for m in re.finditer("(?ia)" + anchor, text)]
        for place in [found[0], found[-1]] if found else []:
            start = max(0, min(place - 180, len(text) - 900))
            if len(starts) < 12 and start not in starts and not any(a <= place < a + 750 for a in starts):
                starts.append(start)
    return starts


def plain_sliding(text: str) -> list[tuple[int, int]]:
    at, n, out = 0, len(text), []
    while at < n and len(out) < 7:
        end = min(at + 900, n)
        if end < n and (back := text.rfind(" ", at + 450, end)) >= 0:
            end = back
        out.append((at, end))
        at = max(end - 150, at + 1) if end < n else n
    tail = max(n - 900, 0)
    return [*out, (tail, n)] if out[-1][1] < n and all(abs(a - tail) >= 50 for a, _ in out) else out


def rows_of(spark, how):
    df = spark.createDataFrame(list(texts().items()), "id long, text string").repartition(2)
    got = ps.windows(df, "id", "text", how)
    return got, sorted((r["id"], r["window_id"], r["start"], r["chunk"]) for r in got.collect())


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_anchored_windows_scan_once(spark):
    """One split an anchor and no whole text beside each window; two splits, three further scans and the text before."""
    got, rows = rows_of(spark, ps.anchored())
    assert rows == sorted((k, i, a, t[a : a + 900]) for k, t in texts().items() if t.strip() for i, a in enumerate(plain_anchored(t)))
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000000")
    plan = optimized(got)
    assert plan.count("split(") == plan.count("regexp_extract_all(") == len(WINDOW_ANCHORS)
    assert not any("Generate" in line and "[__text" in line for line in plan.split("\n"))


def test_sliding_windows_count_the_text_once(spark):
    """Each step read the whole text; now its length is taken once, and the steps read its front."""
    got, rows = rows_of(spark, ps.sliding())
    assert rows == sorted((k, i, a, t[a:e]) for k, t in texts().items() if t.strip() for i, (a, e) in enumerate(plain_sliding(t)))
    assert optimized(got).count("length(") == 1


def test_spans_cut_their_text_once(spark):
    """The value and what stands close come from the quote; each was cut out of the text before."""
    text = {1: "CUSIP 12345678A. " + "\U0001f600 fill " * 90 + "Works Corp. for $12.50 in cash", 2: "$7 par value, " + "w" * 300 + " and $9"}
    df = spark.createDataFrame(list(text.items()), "id long, text string")
    got = ps.spans(df, "id", "text")
    rows = got.collect()
    assert {(r["id"], r["value"]) for r in rows if r["field"] in ("cusip", "cash_consideration")} >= {(1, "12345678A"), (2, "$9")} and not any(r["value"] == "$7" and r["field"] == "cash_consideration" for r in rows)
    for r in rows:
        t = text[r["id"]]
        assert r["value"] == t[r["start"] : r["end"]] and r["source_quote"] == t[max(0, r["start"] - 220) : r["end"] + 220]
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000000")
    assert optimized(got).count("array_join(") == 1


def plain_all(text: str, size: int = 900, overlap: int = 150) -> list[tuple[int, int]]:
    at, n, out = 0, len(text), []
    while at < n:
        end = min(at + size, n)
        if end < n and (back := text.rfind(" ", at + size // 2, end)) >= 0:
            end = back
        out.append((at, end))
        at = max(end - overlap, at + 1) if end < n else n
    return out


def long_texts() -> dict[int, str]:
    return texts() | {104: "\U0001f600 é w " * 20_000, 105: ("y" * 451 + " ") * 90, 106: ("\U0001f600" * 449 + " ") * 90, 107: "a" * 900, 108: "a" * 901, 109: "b" * 300_000}


def of_query(spark, tmp_path, name: str, content: dict) -> list:
    spark.createDataFrame(list(content.items()), "doc_id long, text string").repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    return registry.queries()[name](spark, str(tmp_path)).collect()


def test_sliding_windows_reach_the_end(spark, tmp_path):
    """The query stopped after seven windows and the tail; no part of a long text may be left out."""
    content = long_texts() | {110: None}
    rows = sorted((r["id"], r["window_id"], r["start"], r["chunk"]) for r in of_query(spark, tmp_path, "sliding_windows", content))
    assert rows == sorted((k, i, a, t[a:e]) for k, t in content.items() if t and t.strip() for i, (a, e) in enumerate(plain_all(t)))
    assert max(r[1] for r in rows) > ps.GROUP


def test_all_sliding_windows_of_small_sizes(spark):
    """Windows that move on by one character at least, and groups that are full or not."""
    df = spark.createDataFrame([(k, t[:3000]) for k, t in texts().items()], "id long, text string")
    for size, overlap in ((10, 3), (7, 6), (1, 0), (900, 800)):
        got = sorted((r["id"], r["window_id"], r["start"], r["chunk"]) for r in ps.windows(df, "id", "text", ps.sliding(size, overlap, None)).collect())
        assert got == sorted((k, i, a, t[:3000][a:e]) for k, t in texts().items() if t[:3000].strip() for i, (a, e) in enumerate(plain_all(t[:3000], size, overlap)))


def plain_spans(text: str) -> dict[tuple, int]:
    """The backend's spans in all windows by plain loops, each place of a label with its first window."""
    out: dict = {}
    for number, (a, e) in enumerate(plain_all(text)):
        for p in ps.RuleBackend().predict(text[a:e], list(ps.MERGER_LABELS)):
            field, start, end = ps.MERGER_LABELS[p["label"]], a + p["start"], a + p["end"]
            if field in ps.SHAPES and not re.search(ps.SHAPES[field], p["text"].strip(" ")):
                continue
            if field == "cash_consideration" and re.search(ps.NO_CASH, text[max(0, start - 35) : end + 45]):
                continue
            out.setdefault((p["label"], start, end), (field, p["score"], number))
    return {(field, text[start:end], score, start, end, text[max(0, start - 220) : end + 220], max(0, start - 220), min(len(text), end + 220)): number for (_, start, end), (field, score, number) in out.items()}


def test_spans_of_all_windows_read_the_whole_text(spark, tmp_path):
    """The query looked around the first and last mention of each anchor alone, in twelve windows at most."""
    draw = random.Random(7)
    said = ["Delta Works Corp.", "Big Buyer Holdings Inc. will acquire Small Target Ltd.", "$7 par value", "$1,250.75", "0.7512", "May 3, 2024", "Nasdaq: ABCD", "Nasdaq: ABCDEF", "CUSIP 87654321Z", "ISIN US1234567890", "merger agreement"]
    filler = ["words that say nothing", "\U0001f600 é", "or\n", "x" * 40]
    content = {k: " ".join(draw.choice(said if draw.random() < share else filler) for _ in range(size)) for k, (size, share) in enumerate([(20, 0.5), (300, 0.1), (3000, 0.02), (3000, 0.3), (1, 1.0)])}
    content |= {10: None, 11: "", 12: "z" * 40_000 + "$99", 13: "merger agreement " + "fill " * 9000 + "Middle Words Inc. " + "fill " * 9000 + "merger agreement"}
    got = of_query(spark, tmp_path, "spans_of_all_windows", content)
    shape = ("field", "value", "score", "start", "end", "source_quote", "quote_start", "quote_end")
    before, after = plans._RULED
    assert {r["method"] for r in got} == {"rule"}
    assert sorted(((r["id"], *(r[c] for c in shape)), r["window_id"]) for r in got) == sorted(((k, *span), number) for k, t in content.items() for span, number in plain_spans(before + (t or "") + after).items())
    assert {r["value"] for r in got if r["id"] == 13} >= {"Middle Words Inc."} and max(r["window_id"] for r in got if r["id"] == 13) > 100
