"""Quarantine and cascading release: items that wait for their parents, are retried, and are released in order.

Items of a group are numbered p = 0, 1, ... in the order given; item p arrives at
``every * p`` and may wait for one parent, ``back`` places before it. A faulty item's
attempts fail until it is repaired, and by chance; a failed attempt is retried after
a delay that doubles; after the last failure the item is dead. What waits for a dead
or blocked item is blocked.

1. Numbers: rows are sorted by range over all groups and numbered within their
   partition; a carry for each partition (as many numbers as there are partitions)
   makes the numbers whole. A group with a third of the rows is spread like any other.
2. An item's delivery is a piecewise function of its parent's (``delays``). The forest
   is contracted in parallel: each round takes away all leaves (rake), and of the
   chains an independent set of inner nodes (compress), whose only child takes their
   parent with the composed function. Rounds grow with the logarithm of the items.
3. Expansion: the rounds backwards, each removed node's delivery follows from that of
   its parent at the time of its removal.
4. An item's attempts follow from its parent's delivery, and releases are numbered in
   order of delivery by the same distributed window as in 1, with running sums.

Every step is an equi-join on a unique number (by sorting, never by broadcast, since
all tables grow with the items), a partial aggregation, or a sort by range with unique
keys; each round's tables are written to the shared folder. The
functions of pieces are computed in Arrow batches, row by row.

Rows with a null group or place are no items: all their results are null. Rows that
repeat a place are items of their own, in order of their weights. A null text (weight
of no bytes) counts as empty. Sums wrap at 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ship
from .delays import NEVER, composed, of_item, value_at

DELIVERED, DEAD, BLOCKED = "delivered", "dead", "blocked"


@dataclass(frozen=True)
class Schedule:
    """Seconds between arrivals, before the first retry, and how many attempts there are."""

    every: int = 7
    retry: int = 20
    attempts: int = 6

    @property
    def offsets(self) -> tuple[int, ...]:
        """How long after the start each attempt comes, the delays before doubling from one to the next."""
        return tuple(self.retry * (2**a - 1) for a in range(self.attempts))


# -- the distributed window ---------------------------------------------------------------------------------------

_LOCAL = ("part", "local", "rank", "weights", "weighted")


def running(df: DataFrame, group: str, order: list[str], scratch: Scratch, weight: str | None = None) -> DataFrame:
    """The columns, with ``number`` (from 0 over all rows), ``rank`` (from 1 within the group) and ``weighted``, the sum of rank * weight up to the row.

    ``order`` has to be unique within a group; group and order are long and not null.
    """
    spark = df.sparkSession
    ship(spark)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    names = df.columns
    at, by = names.index(group), names.index(weight) if weight else None
    dealt = df.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order).select("*", F.spark_partition_id().cast("long").alias("part"))
    shape = spark.createDataFrame([], ", ".join(f"`{c}` {t}" for c, t in [*df.dtypes, *((c, "long") for c in _LOCAL)])).schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rank, weights, weighted, seen = None, 0, 0, 0, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            g = batch.column(at).to_numpy(zero_copy_only=False)
            w = np.zeros(n, np.uint64) if by is None else batch.column(by).to_numpy(zero_copy_only=False).astype(np.uint64)
            first = np.append(0, np.flatnonzero(g[1:] != g[:-1]) + 1)
            sizes = np.diff(np.append(first, n))
            ranks = np.arange(n) - np.repeat(first, sizes) + 1
            goes_on = last is not None and g[0] == last
            if goes_on:
                ranks[: sizes[0]] += rank
            sums = []
            for values, before in ((w, weights), (w * ranks.astype(np.uint64), weighted)):
                total = np.append(np.uint64(0), np.cumsum(values, dtype=np.uint64))
                s = total[1:] - np.repeat(total[first], sizes)
                if goes_on:
                    s[: sizes[0]] += np.uint64(before)
                sums.append(s)
            last, rank, weights, weighted = g[-1], int(ranks[-1]), int(sums[0][-1]), int(sums[1][-1])
            more = [np.arange(seen, seen + n), ranks, sums[0].view(np.int64), sums[1].view(np.int64)]
            seen += n
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, more)], names=[*names, *_LOCAL])

    local = scratch.cut(dealt.mapInArrow(count, shape), "sorted")
    ends = local.groupBy("part").agg(F.min(group).alias("head"), F.max_by(F.struct(F.col(group).alias("tail"), "local", "rank", "weights", "weighted"), "local").alias("end")).select("part", "head", "end.*").collect()
    carries, rows, tail, carry = {}, 0, None, (0, 0, 0)
    wrap = lambda x: (x + (1 << 63)) % (1 << 64) - (1 << 63)
    for e in sorted(ends, key=lambda e: e["part"]):
        before = carry if e["head"] == tail else (0, 0, 0)
        carries[e["part"]] = (rows, e["head"], *before)
        if not (e["head"] == e["tail"]):
            before = (0, 0, 0)
        carry = (before[0] + e["rank"], wrap(before[1] + e["weights"]), wrap(before[2] + e["weighted"] + before[0] * e["weights"]))
        rows, tail = rows + e["local"] + 1, e["tail"]
    whole = spark.createDataFrame([], ", ".join(f"`{c}` {t}" for c, t in [*df.dtypes, ("number", "long"), ("rank", "long"), ("weighted", "long")])).schema
    width = len(names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, place, rank, weights, weighted = (batch.column(width + k).to_numpy(zero_copy_only=False) for k in range(len(_LOCAL)))
            g = batch.column(at).to_numpy(zero_copy_only=False)
            start, head, ranks, _, sums = (np.array(c, np.int64) for c in zip(*(carries[p] for p in part.tolist()), strict=True)) if len(part) else (np.zeros(0, np.int64),) * 5
            of_head = g == head
            number, ranks, sums = start + place, np.where(of_head, ranks, 0), np.where(of_head, sums, 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(number), pa.array(rank + ranks), pa.array(weighted + sums + ranks * weights)], names=[*names, "number", "rank", "weighted"])

    return local.mapInArrow(add, whole)


# -- contraction and expansion ------------------------------------------------------------------------------------


def _arrow(df: DataFrame, schema: str, make: Callable[[dict], list]) -> DataFrame:
    """Batches to batches; ``make`` gets the columns as lists and gives the new ones."""
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(df.sparkSession)
    shape = df.sparkSession.createDataFrame([], schema).schema
    arrow = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(make(batch.to_pydict()), arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, shape)


_NODE = "id long, parent long, f array<long>"


def contract(nodes: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """The rounds of a forest ``nodes(id, parent, f)``: each one's rows with ``leaf`` and ``cut``, those that it removes.

    Parents are ids of other rows, or null; there are no cycles.
    """
    alive, rounds = scratch.cut(nodes.select("id", "parent", "f"), "alive"), []
    while not alive.isEmpty():
        turn = F.lit(len(rounds))
        kids = alive.where("parent is not null").groupBy(F.col("parent").alias("at")).agg(F.count("*").alias("kids"), F.min("id").alias("kid"))
        draw = lambda c: F.xxhash64(F.col(c), turn)
        # Of neighbours in a chain only the one with the least draw goes, so that no two removed nodes are parent and child.
        cut = F.coalesce(F.col("parent").isNotNull() & (F.col("kids") == 1) & (draw("id") < draw("parent")) & (draw("id") < draw("kid")), F.lit(False))
        state = scratch.cut(alive.join(kids.hint("merge"), F.col("id") == F.col("at"), "left").select("id", "parent", "f", F.col("kids").isNull().alias("leaf"), cut.alias("cut")), "round")
        gone = state.where("cut").select(F.col("id").alias("via"), F.col("parent").alias("up"), F.col("f").alias("before"))
        rest = state.where("not leaf and not cut").join(gone.hint("merge"), F.col("parent") == F.col("via"), "left").select("id", F.coalesce("up", "parent").alias("parent"), "f", "before")

        def through(c: dict) -> list:
            return [c["id"], c["parent"], [f if b is None else composed(b, f) for f, b in zip(c["f"], c["before"], strict=True)]]

        scratch.drop(alive)
        alive = scratch.cut(_arrow(rest, _NODE, through), "alive")
        rounds.append(state)
    return rounds


def expand(rounds: list[DataFrame], scratch: Scratch) -> DataFrame | None:
    """``id, at`` of all nodes: their deliveries, null for none."""
    known: DataFrame | None = None
    for state in reversed(rounds):
        for kind in ("cut", "leaf"):  # a leaf's parent may have gone in the same round
            rows = state.where(kind).select("id", "parent", "f")
            if known is None:
                joined = rows.withColumn("from", F.lit(None).cast("long"))
            else:
                joined = rows.join(known.select(F.col("id").alias("up"), F.col("at").alias("from")).hint("merge"), F.col("parent") == F.col("up"), "left").select("id", "parent", "f", "from")

            def evaluate(c: dict) -> list:
                out = []
                for parent, f, start in zip(c["parent"], c["f"], c["from"], strict=True):
                    out.append(value_at(f, NEVER) if parent is None else None if start is None else value_at(f, start))
                return [c["id"], out]

            got = scratch.cut(_arrow(joined, "id long, at long", evaluate), f"values-{kind}")
            known = got if known is None else known.unionByName(got)
    return known


# -- the replay ---------------------------------------------------------------------------------------------------


def replay(items: DataFrame, schedule: Schedule | None = None) -> DataFrame:
    """``conv_id, turn, status, attempts, first_at, last_at, release_no, state`` of each of ``items(conv_id, turn, weight, back, wait, passes)``.

    back: places to the parent, 0 for none (or where there is no such place); wait:
    seconds from the arrival to the repair, null if not faulty; passes: a bit for each
    attempt that may deliver after the repair; weight: what a release adds to the
    group's state, times its number.
    """
    schedule = schedule or Schedule()
    offsets = schedule.offsets
    scratch = Scratch(items.sparkSession, "release")
    rows = scratch.cut(items.select("conv_id", "turn", "weight", "back", "wait", "passes", F.monotonically_increasing_id().alias("row")), "items")
    whole = rows.where("conv_id is not null and turn is not null").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("weight").cast("long"), F.col("back").cast("long"), F.col("wait").cast("long"), F.col("passes").cast("long"), "row")
    placed = running(whole, "conv_id", ["turn", "weight", "row"], scratch)
    place = F.col("rank") - 1
    parent = F.when((F.col("back") > 0) & (F.col("back") <= place), F.col("number") - F.col("back"))
    arrival = place * schedule.every
    placed = scratch.cut(placed.select("conv_id", "turn", "weight", "passes", "number", place.alias("place"), parent.alias("parent"), arrival.alias("arrival"), (arrival + F.col("wait")).alias("repaired")), "placed")

    def functions(c: dict) -> list:
        return [c["number"], c["parent"], [of_item(a, r, p, offsets) for a, r, p in zip(c["arrival"], c["repaired"], c["passes"], strict=True)]]

    nodes = _arrow(placed.select("number", "parent", "arrival", "repaired", "passes"), _NODE, functions)
    known = expand(contract(nodes, scratch), scratch)
    if known is None:
        known = items.sparkSession.createDataFrame([], "id long, at long")
    above = known.select(F.col("id").alias("up"), F.col("at").alias("from"))
    start = F.greatest("arrival", "from")

    def delivers(a: int, offset: int) -> Column:
        later = (F.col("start") + offset >= F.col("repaired")) & (F.col("passes").bitwiseAND(F.lit(1 << a).cast("long")) > 0)
        return F.when((F.col("repaired").isNull() & F.lit(a == 0)) | F.coalesce(later, F.lit(False)), F.lit(a + 1))

    judged = placed.join(above.hint("merge"), F.col("parent") == F.col("up"), "left").select("*", (F.col("parent").isNotNull() & F.col("from").isNull()).alias("blocked"), start.alias("start"))
    judged = judged.withColumn("delivered", F.coalesce(*[delivers(a, o) for a, o in enumerate(offsets)]))
    attempts = F.when(F.col("blocked"), 0).otherwise(F.coalesce("delivered", F.lit(len(offsets))))
    status = F.when(F.col("blocked"), BLOCKED).when(F.col("delivered").isNotNull(), DELIVERED).otherwise(DEAD)
    last = F.col("start") + F.element_at(F.array(*[F.lit(o).cast("long") for o in offsets]), F.coalesce("delivered", F.lit(len(offsets))))
    judged = judged.select("conv_id", "turn", "weight", "place", status.alias("status"), attempts.cast("int").alias("attempts"), F.when(~F.col("blocked"), F.col("start")).alias("first_at"), F.when(~F.col("blocked"), last).alias("last_at"))
    judged = scratch.cut(judged, "judged")
    released = running(judged.where(F.col("status") == DELIVERED), "conv_id", ["last_at", "turn", "place"], scratch, "weight")
    shown = ["conv_id", "turn", "status", "attempts", "first_at", "last_at"]
    none = F.lit(None).cast("long")
    out = released.select(*shown, F.col("rank").alias("release_no"), F.col("weighted").alias("state"))
    out = out.unionByName(judged.where(F.col("status") != DELIVERED).select(*shown, none.alias("release_no"), none.alias("state")))
    others = rows.where("conv_id is null or turn is null").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("int").alias("attempts"), *[none.alias(c) for c in ("first_at", "last_at", "release_no", "state")])
    return out.unionByName(others)
