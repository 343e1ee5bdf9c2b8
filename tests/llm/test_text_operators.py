"""Quality, near duplicates and substrings against brute force."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import near_dedup, substrings
from tessera.llm.near_dedup import BINS, near_duplicates, sketch
from tessera.llm.quality import quality
from tessera.llm.substrings import Subtree, maximal_repeats, substring_dedup
from tessera.llm.words import slices

from .helpers import corpus, documents, lower, words


def rows_of(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_words_are_the_pattern_s_words():
    texts = [t for _, t in corpus()]
    found = []
    for i, j, w in slices(pa.array(texts), limit=500):
        for d in range(j - i):
            found.append([w.word(k).decode() for k in range(w.first[d], w.first[d + 1])])
    assert found == [words(t) for t in texts]


def test_quality_counts(spark):
    rows = corpus() + [(900, "a b c\n\na b c\n \na b c\nz # | <x>"), (901, "the of and " * 30), (902, "Un " * 200)]
    got = rows_of(quality(documents(spark, rows, {"n_words": "clash", "kept": "clash"})))
    assert len(got) == len(rows)
    for i, t in rows:
        w = words(t)
        count = Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {k + d for k in range(len(w) - 2) for d in range(3) if count[(w[k], w[k + 1], w[k + 2])] > 1}
        lines = [x for x in (t or "").split("\n") if words(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(cover)), i
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t or "")
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w))
        assert not (r.kept and r.base_failed)


def test_quality_plan_is_native(spark):
    plan = quality(documents(spark, corpus(n=20)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def components(rows, width=5):
    sets = {}
    for i, t in rows:
        w = words(lower(t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("block", "elements"), [(512, 1 << 21), (4, 1 << 21), (1, 1 << 21), (512, 900), (512, 1)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block, elements):
    """Groups in one task; contracted first because they have too many classes, or too many elements."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "CHUNK", max(1, block // 2))
    monkeypatch.setattr(near_dedup, "ELEMENTS", elements)
    rows = corpus(seed=5, n=120)
    got = rows_of(near_duplicates(documents(spark, rows, {"rep": "x", "bands": "x"})))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == components(rows)
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_near_duplicates_with_null_and_repeated_ids(spark):
    rows = corpus(seed=6, n=40)
    more = [*rows, (None, rows[20][1]), (None, None), (rows[21][0], rows[21][1]), (rows[22][0], rows[30][1])]
    got = near_duplicates(documents(spark, more)).collect()
    assert len(got) == len(more)
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    # A repeated id is one node: what its texts are linked with is one component.
    nodes: dict = {}
    sets = {}
    for n, (i, t) in enumerate((i, t) for i, t in more if i is not None):
        nodes.setdefault(i, []).append(n)
        sets[n] = t
    root = {n: r for n, (_, r) in components([(n, t) for n, t in sets.items()]).items()}
    parent = {i: i for i in nodes}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, mine in nodes.items():
        for j, theirs in nodes.items():
            if {root[n] for n in mine} & {root[n] for n in theirs}:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id is not None} == {(i, find(i)) for i in nodes}


def near_copies(n: int, edits: int, seed: int = 2) -> list[tuple[int, str]]:
    import random

    r = random.Random(seed)
    base = [f"v{r.randrange(500)}" for _ in range(120)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = f"x{i}_{r.randrange(500)}"
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("edits", [1, 5])
def test_a_large_group_is_contracted(spark, monkeypatch, edits):
    rows = near_copies(80, edits)
    monkeypatch.setattr(near_dedup, "BLOCK", 2)
    monkeypatch.setattr(near_dedup, "CHUNK", 7)
    got = rows_of(near_duplicates(documents(spark, rows)))
    assert {i: (x.n_shingles, x.component_id) for i, x in got.items()} == components(rows)


def test_work_on_a_large_group_is_in_proportion(spark, monkeypatch):
    """Compared sets of one group of near copies: at ten times the size, about ten times as many."""
    work = []
    real = near_dedup._compared

    def spy(docs, tasks, *rest):
        out = real(docs, tasks, *rest)
        work[-1] += tasks.count()
        return out

    monkeypatch.setattr(near_dedup, "_compared", spy)
    for n in (5_000, 50_000):
        work.append(0)
        got = near_duplicates(documents(spark, near_copies(n, 1)))
        assert got.where("component_id <> 0").count() == 0
    assert work[1] < 15 * work[0] and work[1] < 44 * 50_000


def test_sketch_fills_and_estimates():
    r = np.random.default_rng(1)
    a = r.integers(1, 1 << 62, 400, dtype=np.uint64)
    b = np.concatenate([a[:320], r.integers(1, 1 << 62, 80, dtype=np.uint64)])
    one = a[:1]
    doc = np.repeat([0, 1, 2], [len(a), len(b), 1])
    s = sketch(doc, np.concatenate([a, b, one]), 3)
    assert s.shape == (3, BINS) and (s != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    assert abs((s[0] == s[1]).mean() - 320 / 480) < 0.15


def stripped(rows, length=35):
    where = defaultdict(list)
    for n, (_, t) in enumerate(rows):
        w = words(t)
        for k in range(len(w) - length + 1):
            where[tuple(w[k : k + length])].append((n, k))
    gone = defaultdict(set)
    for places in where.values():
        if len(places) > 1:
            for n, k in places:
                gone[n].update(range(k, k + length))
    return [(len(words(t)), len(gone[n]), hashlib.sha256(" ".join(x for k, x in enumerate(words(t)) if k not in gone[n]).encode()).hexdigest()) for n, (_, t) in enumerate(rows)]


@pytest.mark.parametrize("group", [16384, 20, 1])
def test_substrings_equal_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(substrings, "GROUP", group)
    rows = corpus(seed=8, n=90)
    rows += [(i + 100, t) for i, t in rows[20:24]]  # copies
    rows += [(200, " ".join(f"long{k % 9000}" for k in range(30_000)))]
    got = rows_of(substring_dedup(documents(spark, rows, {"key_a": "x", "starts": "x"}), with_text=True))
    for (i, t), expected in zip(rows, stripped(rows), strict=True):
        r = got[i]
        assert (r.n_words, r.n_removed, r.kept_sha256) == expected, i
        left = " ".join(words(t)) if r.kept_text is None else r.kept_text
        assert hashlib.sha256(left.encode()).hexdigest() == r.kept_sha256


def test_subtree_is_the_suffixes_in_order():
    r = np.random.default_rng(5)
    runs = [r.integers(0, 3, n) for n in (1, 9, 17, 30, 30)] + [np.zeros(20, int)]
    codes, bounds = np.concatenate(runs).astype(np.uint64), np.append(0, np.cumsum([len(x) for x in runs]))
    tree = Subtree(codes, bounds)
    suffix = lambda p: codes[p : bounds[np.searchsorted(bounds, p, "right")]].tolist()
    ordered = [suffix(p) for p in tree.order]
    assert ordered == sorted(ordered) and sorted(tree.order) == list(range(len(codes)))
    same = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    assert tree.shared.tolist() == [same(a, b) for a, b in zip(ordered, ordered[1:], strict=False)]
    depths = tree.depths()
    for p in range(len(codes)):
        assert depths[p] == max(same(suffix(p), suffix(q)) for q in range(len(codes)) if q != p)


def test_maximal_repeats():
    run = np.arange(40, dtype=np.uint64)
    other = run.copy()
    other[39] = 77
    codes = np.concatenate([run, other, run + np.uint64(1000)])
    places, words_ = maximal_repeats(codes, np.array([0, 40, 80, 120]))
    assert places.tolist() == [0, 40] and words_.tolist() == [39, 39]


def test_prefixes_of_many_lengths(spark, monkeypatch):
    """An anchor too frequent for its group is lengthened until the windows with that prefix fit."""
    lengths = set()
    real = substrings.lengthened

    def spy(windows, scratch):
        trees, whole = real(windows, scratch)
        lengths.update(r.n for r in trees.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).collect())
        return trees, whole

    monkeypatch.setattr(substrings, "GROUP", 12)
    monkeypatch.setattr(substrings, "lengthened", spy)
    common = [f"c{i}" for i in range(12)]
    body = [f"b{i}" for i in range(40)]
    rows = [(i, " ".join([f"l{i}_{k}" for k in range(30)] + common + [f"r{i}_{k}" for k in range(30)])) for i in range(30)]
    rows += [(100 + i, " ".join([f"l{100 + i}_{k}" for k in range(30)] + common + body[: 20 + i] + [f"r{100 + i}_{k}" for k in range(20)])) for i in range(20)]
    got = rows_of(substring_dedup(documents(spark, rows)))
    for (i, _), expected in zip(rows, stripped(rows), strict=True):
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == expected, i
    assert lengths and max(lengths) <= 12
