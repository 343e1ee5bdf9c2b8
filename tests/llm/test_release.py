"""Replays against a turn-by-turn simulation; functions of pieces against plain calls; the distributed window."""

from __future__ import annotations

import random
import zlib

from tessera.llm.common import Scratch
from tessera.llm.delays import NEVER, composed, of_item, value_at
from tessera.llm.op_queries.op12 import turns
from tessera.llm.release import Schedule, replay, running

SCHEMA = "conv_id long, turn long, role string, text string"
OFFSETS = Schedule().offsets


def plain(rows: list[tuple]) -> list[tuple]:
    """Every conversation, turn by turn."""
    groups: dict[int, list] = {}
    out = []
    for conv, turn, _, text in rows:
        if conv is None or turn is None:
            out.append((conv, turn, None, None, None, None, None, None))
        else:
            groups.setdefault(conv, []).append((turn, zlib.crc32((text or "").encode())))
    for conv, items in groups.items():
        items.sort()
        results: list[dict] = []
        for p, (turn, weight) in enumerate(items):
            h = lambda k: zlib.crc32(f"{k}:{conv}:{turn}".encode())  # noqa: B023, E731
            back = h(0) % 5
            parent = results[p - back] if 0 < back <= p else None
            faulty, repaired = h(1) % 101 < 50, 7 * p + h(2) % 101
            if parent and parent["status"] != "delivered":
                results.append({"p": p, "turn": turn, "w": weight, "status": "blocked", "attempts": 0, "first": None, "last": None})
                continue
            at = first = max(7 * p, parent["last"] if parent else 0)
            status = "dead"
            for a in range(1, 7):
                if not faulty or (at >= repaired and h(a + 2) % 3):
                    status = "delivered"
                    break
                if a < 6:
                    at += 20 * 2 ** (a - 1)
            results.append({"p": p, "turn": turn, "w": weight, "status": status, "attempts": a, "first": first, "last": at})
        state, order = 0, sorted((r for r in results if r["status"] == "delivered"), key=lambda r: (r["last"], r["turn"], r["p"]))
        for n, r in enumerate(order, 1):
            state += n * r["w"]
            r |= {"no": n, "state": (state + 2**63) % 2**64 - 2**63}
        out += [(conv, r["turn"], r["status"], r["attempts"], r["first"], r["last"], r.get("no"), r.get("state")) for r in results]
    return out


def rows_of(seed: int, sizes: list[int]) -> list[tuple]:
    r = random.Random(seed)
    out = []
    for conv, n in enumerate(sizes):
        places = sorted(r.sample(range(3 * n + 1), n))
        out += [(conv * 17, t, "user", r.choice([None, "", "hello", "日本 Élan", f"text {t}"])) for t in places]
    out += [(None, 1, "user", "x"), (3, None, "user", "x"), (None, None, None, None)] + [out[5]] * 3 + [(out[5][0], out[5][1], "bot", "other")]
    r.shuffle(out)
    return out


def test_replay(spark):
    rows = rows_of(2, [1, 2, 5, 60, 400, 3, 900] + [8] * 40)
    from pyspark.sql import functions as F

    table = spark.createDataFrame(rows, SCHEMA)
    for extra in ("back", "number", "rank", "part", "id"):
        table = table.withColumn(extra, F.lit("x"))
    got = [tuple(g) for g in replay(turns(table)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain(rows)))
    assert {g[2] for g in got} == {None, "delivered", "dead", "blocked"}


def test_one_long_chain(spark):
    """Every item waits for the one before it, so compression alone shrinks the forest."""
    n = 300
    r = random.Random(4)
    given = [(1, t, r.randint(0, 9), 1, r.choice([None, r.randint(0, 100)]), r.choice([63, 62, 48, 32])) for t in range(n)]
    got = {g["turn"]: g for g in replay(spark.createDataFrame(given, "conv_id long, turn long, weight long, back long, wait long, passes long")).collect()}
    start = 0
    for _, t, _, _, wait, passes in given:
        start = max(7 * t, start)
        offset = next(o for a, o in enumerate(OFFSETS) if wait is None or (start + o >= 7 * t + wait and passes >> a & 1))
        assert got[t]["first_at"] == start and got[t]["last_at"] == start + offset
        start += offset


def test_functions_of_pieces():
    r = random.Random(3)
    for _ in range(300):
        items = [(7 * k, r.choice([None, 7 * k + r.randint(0, 100)]), r.choice([63, r.randint(0, 63), r.randint(0, 63)])) for k in range(r.randint(1, 9))]
        functions = [of_item(*item, OFFSETS) for item in items]
        whole = functions[0]
        for f in functions[1:]:
            whole = composed(whole, f)
        for start in [NEVER, *range(0, 900, 3)]:
            at: int | None = start
            for arrival, repaired, passes in items:
                begin = max(arrival, at)
                at = next((begin + o for a, o in enumerate(OFFSETS) if (a == 0 if repaired is None else begin + o >= repaired and passes >> a & 1)), None)
                if at is None:
                    break
            assert value_at(whole, start) == at
        assert len(whole) // 3 < 120


def test_running_spreads_one_group(spark):
    """A group larger than any partition, in order and with carried sums that wrap."""
    r = random.Random(6)
    given = [(r.choice([1, 1, 1, 1, 2, 9]), k, r.randint(0, 2**62)) for k in range(3000)]
    r.shuffle(given)
    out = running(spark.createDataFrame(given, "g long, k long, w long"), "g", ["k"], Scratch(spark, "test"), "w").collect()
    number, rank, sums = 0, {}, {}
    for row in sorted(out, key=lambda x: (x["g"], x["k"])):
        rank[row["g"]] = rank.get(row["g"], 0) + 1
        sums[row["g"]] = sums.get(row["g"], 0) + rank[row["g"]] * row["w"]
        assert (row["number"], row["rank"], row["weighted"]) == (number, rank[row["g"]], (sums[row["g"]] + 2**63) % 2**64 - 2**63)
        number += 1


def test_empty_table(spark):
    assert replay(turns(spark.createDataFrame([], SCHEMA))).count() == 0
    assert [tuple(x) for x in replay(turns(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA))).collect()] == [(None, 1, None, None, None, None, None, None)]
