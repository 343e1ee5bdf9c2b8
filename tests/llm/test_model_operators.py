"""Toxicity, HTML extraction, packing, licenses, decontamination."""

from __future__ import annotations

import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import decontamination, toxicity
from tessera.llm.block_labeller import features, trained
from tessera.llm.block_training import accuracy, gradients
from tessera.llm.decontamination import best_run, leaks
from tessera.llm.html_blocks import blocks
from tessera.llm.html_extraction import extract, main_texts
from tessera.llm.license_templates import TEMPLATES
from tessera.llm.licenses import GUARANTEE, TemplateIndex, align, chosen, licenses, report
from tessera.llm.licenses import _search as license_search
from tessera.llm.packing import Mixture, Shares, pack
from tessera.llm.tokenizer_files import tokenizer_path
from tessera.llm.tokens import alnum_hashes, alnum_slices
from tessera.llm.toxicity import fit, maximal_segments, without_toxic

from .helpers import corpus, documents


def test_maximal_segments_equal_their_definition():
    """All maximal segments: those whose every proper part scores less, and that no such segment contains."""
    r = random.Random(4)
    for _ in range(200):
        s = [r.choice([-3, -2, -1, 1, 2, 3]) for _ in range(r.randint(1, 14))]
        total = np.append(0, np.cumsum(s)).astype(float)
        places = np.flatnonzero(np.array(s) > 0)
        got = sorted((a, b) for a, b, _ in maximal_segments(places, np.stack([total[places], total[places + 1]], axis=1)))

        def split(low, high):  # Ruzzo and Tompa: the best segment, then what is left of it and right
            best = max(((total[b + 1] - total[a], a, b) for a, b in itertools.combinations_with_replacement(range(low, high), 2)), key=lambda x: (x[0], -(x[2] - x[1])), default=(0, 0, 0))
            if best[0] <= 0:
                return []
            return split(low, best[1]) + [(best[1], best[2])] + split(best[2] + 1, high)

        scores = lambda found: sorted(total[b + 1] - total[a] for a, b in found)
        assert scores(got) == scores(split(0, len(s)))


def toxic_corpus(n: int):
    r = random.Random(9)
    neutral, bad = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)], ["vile", "foul", "rotten", "gross"]
    rows, labels = [], []
    for i in range(n):
        w = [r.choice(neutral) for _ in range(r.randint(5, 80))]
        toxic = r.random() < 0.3
        if toxic:
            for _ in range(r.randint(2, 5)):
                w.insert(r.randrange(len(w)), r.choice(bad))
        rows.append((i, " ".join(w)))
        labels.append((i, int(r.random() < 0.5), int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_documents(spark):
    rows, labels = toxic_corpus(600)
    rows += [(1000, None), (1001, ""), (None, "vile foul gross words here"), (1002, "vile foul rotten gross " * 2000)]
    docs = documents(spark, rows, {"score": "clash", "toxic": "clash"})
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = fit(docs, marked.where("doc_id % 3 <> 0"))
    got = {r.doc_id: r for r in toxicity.toxicity(docs, model).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    right = [(got[i].score >= 0.7) == bool(t) for i, _, t in labels if i % 3 == 0]
    assert np.mean(right) > 0.95
    assert got[None].score > 0.7 and got[1002].score > 0.7 and got[1000].score == got[1001].score < 0.3
    text = dict(rows)
    for i, r in got.items():
        for p in r.passages:
            assert text[i][p.start : p.end] == p.text
    kept = without_toxic(docs, model, 0.7)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, r in got.items() if r.score < 0.7}


def unit_hash(unit: bytes) -> int:
    return int(toxicity.Tokens(np.frombuffer(unit, np.uint8), np.array([0, len(unit)])).hashes(lower=True)[0])


def plain_units(text: str | None) -> list[list[bytes]]:
    """Of each token the whole and its beginnings, the longest first."""
    found = re.findall(rb"[a-zA-Z\x80-\xff]+", (text or "").encode())
    return [[t.lower(), *(t.lower()[:k] for k in toxicity.PREFIXES if len(t) > k)] for t in found]


def plain_score(model, text: str | None) -> float:
    known = {int(t): float(v) for t, v in zip(model.tokens, model.scores, strict=True)}
    tokens, own = plain_units(text), []
    for k, units in enumerate(tokens):
        value = next((known[unit_hash(u)] for u in units if unit_hash(u) in known), model.rest)
        value = value if value > 0 else min(value, model.rest)
        own.append(min(value, model.rest) if k and units[0] == tokens[k - 1][0] else value)
    total = [0.0, *itertools.accumulate(own)]

    def split(low, high):
        best = max(((total[b] - total[a], a, b) for a in range(low, high) for b in range(a + 1, high + 1)), key=lambda x: (round(x[0], 9), x[1] - x[2]), default=(0, 0, 0))
        return split(low, best[1]) + [best[0]] + split(best[2], high) if best[0] > 1e-12 else []

    chances = [-math.expm1(-model.k * max(len(own), 1) * math.exp(-model.lam * v)) for v in split(0, len(own))]
    strong = [c for c in chances if c <= toxicity.SIGNIFICANT] or ([min(chances)] if chances else [])
    statistic = min(30.0, sum(-math.log10(max(c, 1e-300)) for c in strong))
    return 1 / (1 + math.exp(-(model.a * statistic + model.b)))


def test_whole_fit_and_score_equal_a_plain_version(spark):
    rows, labels = toxic_corpus(240)
    rows = [(i, t + " Élan,ELAN x2y") for i, t in rows] + [(800, None), (801, ""), (802, "foul foul foul"), (rows[0])]
    docs = documents(spark, rows)
    model = fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    toxic = {i: t for i, _, t in labels}
    count: dict[bytes, list[int]] = {}
    for i, t in rows:  # the texts that hold each unit, by class; the repeated row counts twice
        for u in {u for units in plain_units(t) for u in units} if i in toxic else ():
            count.setdefault(u, [0, 0])[toxic[i]] += 1
    all_ = [sum(c[k] for c in count.values()) for k in (0, 1)]

    def table(prior, least):
        out = {}
        for u, n in count.items():
            alpha = toxicity.FLOOR + prior * sum(n) / sum(all_)
            delta = math.log((n[1] + alpha) / (all_[1] + prior - n[1] - alpha)) - math.log((n[0] + alpha) / (all_[0] + prior - n[0] - alpha))
            if sum(n) >= toxicity.LEAST_COUNT and abs(delta) / math.sqrt(1 / (n[1] + alpha) + 1 / (n[0] + alpha)) >= least:
                out[unit_hash(u)] = round(max(-4.0, min(8.0, delta)), 9)
        return out

    got = {int(t): round(float(v), 9) for t, v in zip(model.tokens, model.scores, strict=True)}
    assert any(got == table(prior, least) and model.rest == rest for prior, least, rest in toxicity.GRID)
    scores = {}
    for r in toxicity.toxicity(docs, model).collect():
        scores[r.doc_id] = r.score
    assert all(abs(scores[i] - plain_score(model, t)) < 1e-9 for i, t in rows)


def test_fit_sees_only_its_labels(spark):
    """Other rows, their labels and their order change nothing."""
    rows, labels = toxic_corpus(150)
    marked = spark.createDataFrame([x for x in labels if x[0] % 3], "doc_id long, quality int, toxic int")
    one = fit(documents(spark, rows), marked)
    other = fit(documents(spark, [(i, t if i % 3 else "vile " * 9) for i, t in reversed(rows)]), marked)
    assert (one.tokens == other.tokens).all() and np.allclose(one.scores, other.scores) and np.allclose([one.lam, one.k, one.a, one.b], [other.lam, other.k, other.a, other.b])


@pytest.mark.parametrize("labels", [[], [(0, 1, 1)], [(0, 1, 0), (None, 1, 1), (3, None, None)]])
def test_toxicity_without_two_classes(spark, labels):
    docs = documents(spark, corpus(n=12))
    model = fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {r.score for r in toxicity.toxicity(docs, model).collect()} == {float(bool(labels and labels[0][2]))}


def test_block_labeller_on_unseen_pages():
    assert accuracy(trained(), n=150) > 0.98


def test_block_gradients():
    r = np.random.default_rng(0)
    from tessera.llm.block_labeller import INPUT, initial

    w = initial()
    x, y = r.normal(size=(4, 3, INPUT)) * 0.2, (r.random((4, 3)) < 0.5).astype(float)
    live = np.array([[1, 1, 1], [1, 1, 0], [1, 0, 0], [1, 0, 0]], bool)
    _, g = gradients(w, x, y, live)
    for k in ("xf", "hb", "cf", "o"):
        at = np.unravel_index(int(np.abs(g[k]).argmax()), g[k].shape)
        for s in (1e-5,):
            up, down = {**w, k: w[k].copy()}, {**w, k: w[k].copy()}
            up[k][at] += s
            down[k][at] -= s
            slope = (gradients(up, x, y, live)[0] - gradients(down, x, y, live)[0]) / (2 * s)
            assert abs(slope - g[k][at]) < 1e-4


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav><!-- ad --><div class="ad">Buy now
or never.</div><article><h1>A &amp; B</h1><p><b>First   one.<br><p>Second&nbsp;with <i>in</i>line &#233;<script>x()</script>.</p>
<p></p><p>Third one is a longer paragraph with several words, and a comma.</article>
<section class="comments"><h3>Comments</h3><p>I like it.</p></section><form><p>Search</p><input></form><footer>&copy; x</footer>"""


def test_main_text():
    (text, n, kept), empty, none, nothing = main_texts([PAGE, "", None, "<html><head><title>x</title></head>"])
    assert text == "A & B\nFirst one.\nSecond with inline é.\nThird one is a longer paragraph with several words, and a comma."
    assert (n, kept) == (11, 4) and empty == none == nothing == ("", 0, 0)


@pytest.mark.parametrize("page", ["<", "<p", "<!--", "a < b > c", "</p></div>x", "<p a='>x", "<script>", "<div " * 50, "\x00<b>", "<p>" * 3000 + "x", "&#xD800; &#0; &bogus;"])
def test_odd_pages(page):
    assert isinstance(main_texts([page])[0][0], str)
    assert all(b.text == " ".join(b.text.split()) for b in blocks(page))


def test_deep_pages_take_memory_in_proportion():
    import tracemalloc

    peaks = []
    for depth in (10_000, 100_000):
        page = "<div class='a b'>x" * depth + "</span></em>" * depth + "<p>The end of it, in a sentence.</p>" + "</div>" * depth
        tracemalloc.start()
        found = blocks(page)
        features([found])
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert len(found) == depth + 1 and found[-1].element.depth == depth + 1
    assert peaks[1] < 15 * peaks[0]
    assert isinstance(main_texts([page])[0][0], str)


def test_no_text_is_dropped_unjudged():
    page = "<p>One <math>x + y</math> two <svg><text>label</text></svg></p><noscript><p>Turn it on</p></noscript><template><p>Later</p></template><iframe>framed</iframe><object>thing</object><style>s</style><script>c</script>"
    assert [b.text for b in blocks(page)] == ["One x + y two", "label", "Turn it on", "Later", "framed", "thing"]


def test_extract_rows(spark):
    rows = [(1, "http://a/", PAGE), (1, "http://a/", PAGE), (None, None, None), (2, None, "")]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_blocks")).collect()
    assert sorted((r.page_id or 0, len(r.text) > 0) for r in got) == [(0, False), (1, True), (1, True), (2, False)]


def stream(schedule, tokens, r):
    """Queue and token at each place of the stream, from cuts of documents of random lengths."""
    out: dict[int, tuple[int, int]] = {}
    for q, n in enumerate(tokens):
        x = 0
        while x < n:
            size = min(n - x, r.randint(1, 90))
            for at, take, place in schedule.cuts(q, x, size):
                for k in range(take):
                    assert place + k not in out
                    out[place + k] = (q, at + k)
            x += size
    assert sorted(out) == list(range(sum(tokens)))  # gapless
    flat = [out[p] for p in range(len(out))]
    for q, n in enumerate(tokens):
        assert [x for k, x in flat if k == q] == list(range(n))  # in the queue's order
    return [q for q, _ in flat]


@pytest.mark.parametrize("tokens", [[7, 500, 93, 50, 2400], [64], [1000, 1000], [3000, 64, 64]])
def test_shares_are_met_in_every_window(tokens):
    window, total = 64, sum(tokens)
    tokens = [t for t in tokens if t * window >= total]
    total = sum(tokens)
    flat = stream(Shares([0, *itertools.accumulate(tokens)], window), tokens, random.Random(1))
    for w in range(0, total - window + 1, window):
        for q, t in enumerate(tokens):
            assert abs(flat[w : w + window].count(q) - window * t / total) < 2


@pytest.mark.parametrize("seed", range(6))
def test_given_weights_are_met_until_a_queue_is_dry(seed):
    r = random.Random(seed)
    window, weights = 64, [r.choice([1, 2, 5, 10]) for _ in range(4)] + [0]
    tokens = [r.choice([0, 1, 100, 700, 2000]) for _ in weights]
    flat = stream(Mixture(tokens, weights, window), tokens, r)
    served = [0] * len(tokens)
    for w in range(0, len(flat), window):
        part = flat[w : w + window]
        counts = [part.count(q) for q in range(len(tokens))]
        live = [q for q in range(len(tokens)) if weights[q] and served[q] < tokens[q]]
        dry = any(served[q] + counts[q] == tokens[q] for q in live)
        if live and not dry:
            for q in live:
                assert abs(counts[q] - window * weights[q] / sum(weights[k] for k in live)) < 2
            assert counts[-1] == 0
        served = [a + b for a, b in zip(served, counts, strict=True)]


def test_weights_too_small():
    with pytest.raises(ValueError):
        Mixture([10, 10], [1, 1000], 64)


def test_pack_by_weights(spark):
    rows = [(i, "alpha beta gamma delta " * 20) for i in range(60)]
    docs = documents(spark, rows)
    pieces = pack(docs, tokenizer_path(), sequence=64, window_sequences=4, weights={"s1": 3, "s2": 1}).collect()
    share: dict = {}
    for p in pieces:
        share.setdefault(p.sequence_id // 4, {}).setdefault(p.source, 0)
        share[p.sequence_id // 4][p.source] += p.length
    for k in range(6):
        assert abs(share[k]["s1"] - 192) < 2 and abs(share[k]["s2"] - 64) < 2 and len(share[k]) == 2
    ends = {p.source: min(q.sequence_id for q in pieces if q.source == p.source) for p in pieces}
    assert ends[None] == ends["s0"] or min(ends[None], ends["s0"]) > max(ends["s1"], ends["s2"])
    assert sum(p.length for p in pieces) == sum({(p.doc_id): p.doc_tokens for p in pieces}.values())


def test_small_sources_and_a_hot_one(spark):
    rows = [(i, "word " * 300) for i in range(40)] + [(100 + i, "a") for i in range(30)]
    docs = documents(spark, rows).selectExpr("doc_id", "text", "CASE WHEN doc_id < 40 THEN 'hot' ELSE concat('t', doc_id) END AS source")
    got: dict = {}
    for p in sorted(pack(docs, tokenizer_path(), sequence=32, window_sequences=2).collect(), key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == got.get(p.sequence_id, 0)
        got[p.sequence_id] = p.offset + p.length
    assert sorted(got) == list(range(len(got))) and set(list(got.values())[:-1]) == {32}


def test_pack_round_trip(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    rows = corpus(n=70) + [(5, "a repeated id"), (None, "no id <|endoftext|> here"), (200, "it's \u0130stanbul ΣΑΣ x<y 12.5 e\u0301")]
    docs = documents(spark, rows, {"n": "x", "ids": "x", "row": "x"})
    pieces = pack(docs, tokenizer_path(), sequence=256).collect()
    got: dict = {}
    for p in sorted(pieces, key=lambda p: (p.doc_id or -1, p.doc_tokens, p.start)):
        got.setdefault((p.doc_id, p.doc_tokens, p.source), []).append(p)
    expected = sorted((tuple(tokenizer.encode(t or "", add_special_tokens=False).ids) + (1,) for _, t in rows))
    assert sorted(tuple(np.frombuffer(b"".join(bytes(p.ids) for p in v), "<u4").tolist()) for v in got.values()) == expected
    at = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == at.get(p.sequence_id, 0) and p.length == len(p.ids) // 4
        at[p.sequence_id] = p.offset + p.length
    assert sorted(at) == list(range(len(at))) and all(v == 256 for k, v in at.items() if k < len(at) - 1)
    assert pack(documents(spark, []), tokenizer_path()).count() == 0


def test_licenses(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without any restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to these following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    rows = [(1, "é before\n" + mit + "\nafter"), (2, "Released under the MIT License."), (3, "nothing of the kind under the sun"), (4, None), (5, ""), (6, "Licensed under CC BY-NC 4.0. Licensed under the Apache License, Version 2.0!"), (None, "released  UNDER the mit license"), (7, "word " * 50_000 + "Released under the MIT License.")]
    docs = documents(spark, rows, {"license": "x", "start": "x"})
    got = licenses(docs).collect()
    assert sorted((r.doc_id or 0, r.license) for r in got) == [(0, "MIT"), (1, "MIT"), (2, "MIT"), (6, "Apache-2.0"), (6, "CC-BY-NC-4.0"), (7, "MIT")]
    text = dict(rows)
    assert all(text[r.doc_id][r.start : r.end] == r.passage and 0.8 <= r.coverage <= 1 for r in got)
    assert licenses(documents(spark, [])).count() == 0


def test_align_within_its_band():
    template = np.arange(30)
    text = np.array([900, 901, *range(10), 902, *range(10, 20), *range(21, 30), 903])
    mine, theirs = align(template, text, 2, 8)
    assert mine.tolist() == [*range(20), *range(21, 30)] and (theirs[0], theirs[-1]) == (2, 31)
    assert (template[mine] == text[theirs]).all()
    assert len(align(template, np.array([5, 5, 5]), 0, 8)[0]) == 1
    assert len(align(template, np.array([], int), 0, 8)[0]) == 0


def plain_alignment(a, b):
    """The best score of a local alignment of a and b, without a band."""
    score, best = np.zeros((len(a) + 1, len(b) + 1), int), 0
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            score[i + 1, j + 1] = max(0, score[i, j] + (1 if x == y else -1), score[i, j + 1] - 1, score[i + 1, j] - 1)
            best = max(best, score[i + 1, j + 1])
    return best


def test_align_equals_the_whole_table():
    r = random.Random(11)
    for _ in range(150):
        a = np.array([r.randint(0, 4) for _ in range(r.randint(1, 12))])
        b = np.array([r.randint(0, 4) for _ in range(r.randint(1, 12))])
        mine, theirs = align(a, b, 0, 30)
        gaps = sum(max(x, y) for x, y in zip(np.diff(mine) - 1, np.diff(theirs) - 1, strict=True))
        assert len(mine) - gaps == plain_alignment(a.tolist(), b.tolist())


def test_every_template_is_its_own_license(spark):
    """Each template alone is reported as its license; so none is taken for another's."""
    flat = [(name, text.replace("{", "").replace("}", "")) for name, texts in TEMPLATES.items() for text in texts]
    docs = documents(spark, [(k, f"Some words before. {text} Some words after.") for k, (_, text) in enumerate(flat)])
    got: dict = {}
    for r in licenses(docs).collect():
        got.setdefault(r.doc_id, set()).add((r.license, round(r.coverage, 6)))
    assert got == {k: {(name, 1.0)} for k, (name, _) in enumerate(flat)}


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Licensed under the FooBar License.", None), ("This project is licensed under the terms of the Zlib license.", None), ("Licensed under CC BY-XX 4.0.", None),
        ("This work is licensed under the GNU General Public License, version 1.", None), ("This work is licensed under the GNU General Public License, version 2.1.", None),
        ("This work is licensed under the GNU Foo General Public License, version 2.", None), ("Licensed under the MIT-0 License.", None), ("Released under the X-MIT License.", None),
        ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"), ("Licensed under the Apache License, Version 1.1.", None), ("Licensed under CC BY 3.0.", None),
        ("This work is licensed under the GNU General Public License, version 3.0!", "GPL-3.0"), ("released\nunder\nthe mit license", "MIT"), ("Licensed under the BSD 3-Clause \"New\" License.", "BSD-3-Clause"),
        ("MIT License", None), ("Released under the MIT Press License", None),
    ],
)
def test_only_licenses_that_are_there(text, expected):
    data = pa.array([text])
    index = TemplateIndex(TEMPLATES)
    found = [index.names[r[4]] for _, _, tokens in alnum_slices(data) for _, r in license_search(index, tokens)]
    assert found == ([expected] if expected else [])


def test_licenses_equal_brute_force():
    """The reports are those of all templates at all places, without index and band."""
    r = random.Random(12)
    index, texts = TemplateIndex(TEMPLATES), []
    flat = [text.replace("{", "").replace("}", "").split() for texts_ in TEMPLATES.values() for text in texts_ if len(text) < 900]
    for _ in range(120):
        w = list(r.choice(flat))
        for _ in range(r.choice([0, 0, 1, 1, 2, len(w) // 8])):
            at = r.randrange(len(w))
            w[at : at + r.randint(0, 1)] = r.choice([[], ["other"], [r.choice(w)]])
        texts.append(" ".join([*["lead"] * r.randint(0, 20), *w, *["tail"] * r.randint(0, 20)]))
    for _, _, tokens in alnum_slices(pa.array(texts)):
        h = tokens.hashes(lower=True)
        got: dict = {}
        for d, x in license_search(index, tokens):
            got.setdefault(d, []).append(x)
        for d in range(len(texts)):
            low, high = int(tokens.first[d]), int(tokens.first[d + 1])
            whole = [report(index, tokens, h, d, t, low, low, high, high - low + 400) for t in range(len(index.names))]
            expected = chosen(index, [(*x, t) for t, x in enumerate(whole) if x])
            assert all(x[4] in [t for t, y in enumerate(whole) if y] for x in got.get(d, []))
            for x in expected:  # what winnowing can't promise: no GUARANTEE tokens in a row are the template's
                if x not in got.get(d, []):
                    template, text = index.tokens[x[4]].tolist(), h[low:high].tolist()
                    runs = {tuple(template[k : k + GUARANTEE]) for k in range(len(template) - GUARANTEE + 1)}
                    assert not runs & {tuple(text[k : k + GUARANTEE]) for k in range(len(text) - GUARANTEE + 1)}


def test_license_ties_and_repeated_rows(spark):
    docs = documents(spark, [(1, "Licensed under the X License."), (1, "Licensed under the X License."), (None, "Licensed under the X License.")])
    got = licenses(docs, {"B": ("Licensed under the {X License}.",), "A": ("Licensed under the {X License}.",)}).collect()
    assert [r.license for r in got] == ["B"] * 3  # of equals the first template


def edits(a, b):
    """The least edits from a to any run of b."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [row[0] + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_leaks_equal_brute_force(spark):
    r = random.Random(6)
    vocabulary = [f"w{i}" for i in range(150)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(5, 40)))) for i in range(25)] + [(90, None), (91, " .. "), (92, "short"), (0, "w1 w2 w3 w4 w5 w6 w7")]
    rows: list = [(500, None), (501, ""), (502, "!!"), (None, items[3][1])]
    for i in range(150):
        w = [r.choice(vocabulary) for _ in range(r.randint(0, 60))]
        if r.random() < 0.6:
            leak = r.choice(items[:25])[1].split()
            for _ in range(r.randint(0, max(1, len(leak) // 4))):
                p = r.randrange(len(leak))
                leak[p : p + r.randint(0, 1)] = r.choice([[], [r.choice(vocabulary).upper() + ","]])
            at = r.randint(0, len(w))
            w = w[:at] + leak + w[at:]
        rows.append((i, " ".join(w)))
    docs = documents(spark, rows, {"item_id": "x", "edits": "x"})
    found = leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(f.doc_id, f.item_id, f.item_tokens) for f in found}
    expected = set()
    for (i, t), (k, x) in itertools.product(rows, items):
        a, b = alnum_hashes(x or "").tolist(), alnum_hashes(t or "").tolist()
        if a and b and edits(a, b) <= int(len(a) * decontamination.EDIT_RATE + 1e-9):
            expected.add((i, k, len(a)))
    assert got <= expected and len(got & expected) >= 0.98 * len(expected)
    text = dict(rows)
    assert all(text[f.doc_id][f.start : f.end] == f.passage for f in found)
    kept = decontamination.without_leaks(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert {x.doc_id for x in kept.select("doc_id").collect()} == {i for i, _ in rows} - {f.doc_id for f in found}


@pytest.mark.parametrize("length", [5, 8, 12, 20, 30, 50, 120])
def test_bit_sampling_passes_leaks_and_little_else(length):
    """Windows at the edit bound pass with at least 0.95, unrelated ones (of a skewed vocabulary) with less than 0.01, or 0.02 if they have five tokens."""
    r, n = random.Random(length), 400
    words = [int(x) for x in np.random.default_rng(length).integers(1, 1 << 62, 3000)]
    often = [1 / (k + 2) for k in range(len(words))]  # the most frequent is one word in 22, as in English
    draw = lambda: r.choices(words, often)[0]
    items = np.array([[draw() for _ in range(length)] for _ in range(n)], np.uint64)
    tables = decontamination.Length(length, np.arange(n), items)

    def share(rows, sizes):
        row, item = tables.candidates(rows, sizes)
        return len({a for a, b in zip(row.tolist(), item.tolist(), strict=True) if a == b}) / n

    near, sizes = np.zeros((n, length), np.uint64), np.zeros(n, np.int64)
    for k, item in enumerate(items.tolist()):
        for _ in range(int(length * decontamination.EDIT_RATE + 1e-9)):
            at = r.randrange(len(item))
            item[at : at + r.randint(0, 1)] = r.choice([[], [r.choice(words)]])
        sizes[k] = min(len(item), length)
        near[k, : sizes[k]] = item[: sizes[k]]
    other = np.array([[draw() for _ in range(length)] for _ in range(n)], np.uint64)
    assert share(items, np.full(n, length)) == 1
    assert share(near, sizes) >= 0.95
    assert share(other, np.full(n, length)) < (0.01 if length > 5 else 0.02)


def test_best_run():
    item = np.array([1, 2, 3, 4], np.uint64)
    assert best_run(item, np.array([9, 1, 2, 3, 4, 9], np.uint64)) == (0, 1, 5)
    assert best_run(item, np.array([9, 1, 3, 4, 9], np.uint64)) == (1, 1, 4)


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_ITEMS", 4)
    items = [(i, f"alpha{i} beta{i} gamma{i} delta{i} eps{i} zeta{i}") for i in range(11)]
    docs = documents(spark, [(i, "before " + t + " after") for i, t in items])
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sorted((f.doc_id, f.item_id) for f in leaks(docs, bench).collect()) == [(i, i) for i in range(11)]
    assert decontamination.without_leaks(docs, bench).count() == 0
    assert leaks(docs, bench.limit(0)).count() == 0
