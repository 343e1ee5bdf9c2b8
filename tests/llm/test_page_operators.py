"""WARC archives and url verdicts."""

from __future__ import annotations

import base64
import hashlib
import struct

import pytest
import zstandard

from tessera.llm.url_filter import Rule, url_verdicts
from tessera.llm.warc import ArchiveError, open_archives, parse_record, read_archives, read_frames, record_bytes, round_trip, save_archives, write_archive, write_archives

PAGES = "page_id long, url string, html string"


def digest(text: str) -> str:
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def test_round_trip(spark):
    rows = [(i, f"http://h{i % 3}/é\n{i}", ["<p>same</p>", None, "", f"<p>{'é' * i}</p>", "x" * 100_000][i % 5]) for i in range(400)]
    rows += [(1000, None, "alone"), (None, "u", "without id"), (None, "u", "<p>same</p>")]
    pages = spark.createDataFrame(rows, PAGES).selectExpr("*", "'x' AS digest", "1 AS response")
    got = round_trip(pages).collect()
    assert len(got) == len(rows) and all(r.valid for r in got)
    assert len({r.record_id for r in got}) == len(rows)
    largest: dict = {}
    for i, _, t in rows:
        largest[t or ""] = max(largest.get(t or "", -1), -1 if i is None else i)
    name = lambda i: f"urn:tessera:page:{'none' if i is None else i}"
    expected = []
    for i, _, t in rows:
        t = t or ""
        copies = sum((x or "") == t for _, _, x in rows)
        refers = name(largest[t]) if copies > 1 and i != largest[t] and largest[t] >= 0 else None
        expected.append((name(i), len(t.encode()), digest(t), "revisit" if refers else "response", refers))
    order = lambda x: [str(v) for v in x]
    page = lambda ident: ident and ident.rpartition(":")[0]
    assert sorted(((page(r.record_id), r.payload_bytes, r.payload_digest, r.record_type, page(r.refers_to)) for r in got), key=order) == sorted(expected, key=order)
    assert round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_equal_rows_have_one_response(spark):
    rows = [(5, "u", "same")] * 4 + [(None, "u", "lone")] * 3 + [(6, "u", "other")]
    got = round_trip(spark.createDataFrame(rows, PAGES)).collect()
    by = {d: sorted((r for r in got if r.payload_digest == d), key=lambda r: r.record_type) for d in {r.payload_digest for r in got}}
    assert len({r.record_id for r in got}) == len(rows)
    for some in by.values():
        assert [r.record_type for r in some] == ["response"] + ["revisit"] * (len(some) - 1)
        assert all(r.refers_to == some[0].record_id for r in some[1:])


def test_payloads_and_files(spark, tmp_path):
    pages = spark.createDataFrame([(i, "http://x/", f"<p>{i} é</p>" * 400) for i in range(200)], PAGES)
    save_archives(write_archives(pages), str(tmp_path / "out"))
    files = sorted((tmp_path / "out").glob("*.warc.zst"))
    assert files
    for file in files:  # as another reader would: the dictionary from the leading frame, then all frames
        content = file.read_bytes()
        magic, size = struct.unpack_from("<II", content)
        assert magic == 0x184D2A5D
        dictionary = {"dict_data": zstandard.ZstdCompressionDict(content[8 : 8 + size])} if size else {}
        with zstandard.ZstdDecompressor(**dictionary).stream_reader(content[8 + size :], read_across_frames=True) as reader:
            assert reader.read().count(b"WARC/1.1\r\n") > 0
    got = read_archives(open_archives(spark, str(tmp_path / "out"))).collect()
    assert sorted(bytes(r.payload).decode() for r in got) == sorted(f"<p>{i} é</p>" * 400 for i in range(200))


def test_records_above_the_limit_are_reported_not_held(spark):
    content = write_archive([*records(3), record_bytes("urn:x:big", None, b"a" * 5_000_000, hashlib_b32(b"a" * 5_000_000), None), *records(2)])
    got = read_archives(spark.createDataFrame([("a", content)], "path string, content binary"), max_record_bytes=1_000_000).collect()
    assert [r.error for r in got if not r.valid] == ["larger than max_record_bytes"] and sum(r.valid for r in got) == 5


def records(n: int) -> list[bytes]:
    return [record_bytes(f"urn:x:{i}", "http://x/", b"payload %d " % i * 200, hashlib_b32(b"payload %d " % i * 200), None) for i in range(n)]


def hashlib_b32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@pytest.mark.parametrize("n", [0, 1, 400])
def test_archive_has_a_frame_for_each_record(n):
    made = records(n)
    content = write_archive(made)
    assert list(read_frames(content)) == made
    assert (content[4:8] != b"\0\0\0\0") == (n == 400)  # a dictionary where there is enough to learn from


def test_damaged_archives(spark):
    content = write_archive(records(20))
    with pytest.raises(ArchiveError):
        list(read_frames(content[:-5]))
    with pytest.raises(ArchiveError):
        list(read_frames(content[:8] + b"junk" + content[8:]))
    rows = [("cut", content[:-5]), ("empty", b""), ("none", None), ("whole", content)]
    got = read_archives(spark.createDataFrame(rows, "path string, content binary")).collect()
    assert [r.error for r in got if r.path == "cut" and not r.valid] == ["truncated frame"]
    assert sum(r.valid for r in got) == 39


@pytest.mark.parametrize(
    ("change", "error"),
    [
        ((b"WARC/1.1", b"HTTP/1.1"), "no WARC header"),
        ((b"WARC-Date", b"X-Date"), "without warc-date"),
        ((b"payload 3", b"payload 4"), "block digest"),
        ((b"Content-Length: 2", b"Content-Length: 3"), "content length"),
    ],
)
def test_damaged_records(change, error):
    raw = records(4)[3]
    assert parse_record(raw)["error"] is None
    assert parse_record(raw.replace(*change))["error"] == error


def test_rules_and_parts(spark):
    urls = {
        "http://A.Example.NET/en/x?q#f": ("a.example.net", "/en/x", "example.net/en/", "allow"),
        "https://net/": ("net", "/", "net/", "block"),
        "http://x.net": ("x.net", "", None, "allow"),
        "http://planet/": ("planet", "/", None, "allow"),
        "http://m.example.com/de/1": ("m.example.com", "/de/1", "example.com/de/", "block"),
        "http://m.example.com/en/": ("m.example.com", "/en/", None, "allow"),
        "http://www.x.org/fr/?a=/b": ("www.x.org", "/fr/", "org/fr/", "allow"),
        "no scheme": ("", "", None, "allow"),
        "a://b://c/d": ("b:", "//c/d", None, "allow"),
        "http://?x": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    rows = [(i, u, None) for i, u in enumerate(urls)] + [(20 + i, "http://m.example.com/en/", "") for i in range(4)]
    got = {r.url_: r for r in url_verdicts(spark.createDataFrame(rows, PAGES).selectExpr("*", "'x' AS host", "'x' AS rule")).join(spark.createDataFrame([(r[0], r[1]) for r in rows], "page_id long, url_ string"), "page_id").collect()}
    assert {u: (r.host, r.path, r.rule, r.verdict) for u, r in got.items()} == urls
    assert url_verdicts(spark.createDataFrame([], PAGES)).count() == 0


def test_propagation_equals_power_iteration(spark):
    links = {"bad.b": [], "near.x": ["bad.b", "bad.b", "mid.x"], "mid.x": ["near.x", "good.g"], "far.x": ["mid.x"], "good.g": ["fine.x", "far.x"], "fine.x": ["good.g"]}
    rows = [(k, f"http://{h}/p", "".join(f'<a class="c" HREF="http://{t.upper()}/q">x</a><a href="/own">y</a>' for t in to)) for k, (h, to) in enumerate(links.items())]
    rules = (Rule("b", "/", "block"), Rule("g", "/", "allow"))
    got = {r.host: r for r in url_verdicts(spark.createDataFrame(rows, PAGES), rules, threshold=0.2).collect()}
    damping, steps = 0.85, 8
    count = lambda a, b: links[a].count(b)
    for name, seed, back in (("trust", "good.g", False), ("distrust", "bad.b", True)):
        score = {h: 0.15 * (h == seed) for h in links}
        for _ in range(steps):
            new = {h: 0.15 * (h == seed) for h in links}
            for a in links:
                for b in links:
                    if count(a, b):
                        if back:
                            new[a] += damping * score[b] * count(a, b) / sum(count(x, b) for x in links)
                        else:
                            new[b] += damping * score[a] * count(a, b) / len(links[a])
            score = new
        assert all(abs(got[h][name] - score[h]) < 1e-8 for h in links), name
    assert got["near.x"].verdict == "block" and got["fine.x"].verdict == "allow"


def test_links_without_a_scheme_and_base(spark):
    rows = [
        (1, "http://a.x/p", "<a href='//bad.b/q'>x</a><a href=/own>y</a><a href='#top'>z</a>"),
        (2, "https://c.x/p", "<base href='https://bad.b/dir/'><a href=one>x</a><a href='mailto:me@a.x'>m</a>"),
        (3, "https://d.x/p", "<a href=one>x</a><a href='mailto:me@bad.b'>m</a>"),
        (4, "http://bad.b/", None), (5, "http://bad.b/", None), (5, "http://bad.b/", None),
    ]
    got = url_verdicts(spark.createDataFrame(rows, PAGES), (Rule("b", "/", "block"),), threshold=0.2).collect()
    assert len(got) == len(rows)
    assert {r.host: (r.verdict, r.distrust > 0) for r in got} == {"a.x": ("block", True), "c.x": ("block", True), "d.x": ("allow", False), "bad.b": ("block", True)}
