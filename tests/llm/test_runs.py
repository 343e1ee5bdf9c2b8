"""Periodic runs against the definition, place by place and period by period."""

from __future__ import annotations

import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from tessera.llm.op_queries.op13 import made_periodic
from tessera.llm.runs import find_runs, next_smaller, periodic_runs

from .helpers import corpus, documents, words


def plain_runs(w: list, fewest: int = 12) -> list[tuple[int, int, int]]:
    """Every maximal stretch with period q, for the smallest such q."""
    n, seen, found = len(w), set(), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            k = i
            while k + q < n and w[k] == w[k + q]:
                k += 1
            if k + q - i >= 2 * q and (i, k + q) not in seen:
                seen.add((i, k + q))
                if k + q - i >= max(fewest, 2 * q):
                    found.append((i, k + q - i, q))
            i = k + 1
    return sorted(found)


def plain_row(text: str | None) -> tuple:
    w = words(text)
    runs = plain_runs(w)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def plain_periodic(ident: int | None, text: str | None) -> str | None:
    w, h = words(text), zlib.crc32(str(ident).encode())
    if ident is None or h % 10 or not w:
        return text
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return " ".join(x if i < a else w[a + (i - a) % p] for i, x in enumerate(w))


@pytest.mark.parametrize("fewest", [2, 12])
def test_find_runs(fewest):
    """Words of small alphabets, so that runs overlap, nest and end at both ends; many texts in one sequence."""
    r = random.Random(1)
    texts: list[list[int]] = [[], [1], [1, 1], [2] * 40, [1, 2] * 30, [1, 1, 2] * 9 + [1], list(range(30)) * 2, []]
    for _ in range(400):
        k = r.choice([1, 2, 2, 3, 5])
        texts.append([r.randint(1, k) for _ in range(r.randint(0, 60))])
    for _ in range(60):
        base = [r.randint(1, 4) for _ in range(r.randint(1, 9))]
        texts.append([r.randint(1, 4) for _ in range(r.randint(0, 5))] + (base * 30)[: r.randint(5, 90)] + [r.randint(1, 4) for _ in range(r.randint(0, 5))])
    fib = [[1], [1, 2]]
    while len(fib[-1]) < 300:
        fib.append(fib[-1] + fib[-2])
    texts += fib
    first = np.cumsum([0] + [len(t) for t in texts])
    h = np.array([x * 7919 % 97 for t in texts for x in t], np.uint64)
    found: dict[int, list] = {}
    for d, *run in zip(*(x.tolist() for x in find_runs(h, first, fewest)), strict=True):
        found.setdefault(d, []).append(tuple(run))
    for d, t in enumerate(texts):
        assert found.get(d, []) == plain_runs(t, fewest), t


def test_against_plain(spark):
    rows: list[tuple[int | None, str | None]] = corpus(9, 120)
    rows = [(i * 13, t) for i, t in rows] + [(None, "a b " * 9), (None, "x y z " * 7), (5, "x y z " * 7), (5, "x y z " * 7), (6, "日本 Élan " * 8 + "end")]
    changed = made_periodic(documents(spark, rows, {"words": "x"}))
    assert sorted(map(str, ((r["doc_id"], words(r["text"])) for r in changed.collect()))) == sorted(map(str, ((i, words(plain_periodic(i, t))) for i, t in rows)))
    got = periodic_runs(changed).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, ((i, *plain_row(plain_periodic(i, t))) for i, t in rows)))
    assert sum(r["n_runs"] > 0 for r in got) > 10


def test_long_texts_take_time_in_proportion():
    r = np.random.default_rng(3)
    seconds = []
    for n in (100_000, 200_000):
        parts = [r.integers(1, 50, 1000), np.tile(r.integers(1, 50, 37), n // 74)[: n // 2], np.ones(n // 4, np.int64), r.integers(1, 50, n // 4)]
        h = np.concatenate(parts).astype(np.uint64)
        began = time.perf_counter()
        found = find_runs(h, np.array([0, len(h)]))
        seconds.append(time.perf_counter() - began)
        assert {37, 1} <= set(found[3].tolist())
    assert seconds[1] < 4 * seconds[0] + 1


def test_empty_table(spark):
    assert periodic_runs(documents(spark, [(1, "x")]).limit(0)).count() == 0


@pytest.mark.parametrize("rounds", [0, 2, 24])
def test_next_smaller(rounds):
    r = np.random.default_rng(2)
    for n in (0, 1, 2, 50, 3000):
        stairs = np.concatenate([[-1], np.arange(n)[::-1]])
        for values in (r.permutation(n), stairs, np.concatenate([r.permutation(n) + 5000, stairs])):
            got = next_smaller(values.astype(np.int64), rounds)
            plain = [next((j for j in range(i + 1, min(len(values), i + 4000)) if values[j] < values[i]), len(values)) for i in range(len(values))] if n < 100 else None
            if plain is not None:
                assert got.tolist() == plain
            for i in range(0, len(values), 97):
                assert (values[i + 1 : got[i]] > values[i]).all() and (got[i] == len(values) or values[got[i]] < values[i])
