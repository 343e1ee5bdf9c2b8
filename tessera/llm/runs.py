"""Periodic runs of words by the runs theorem, and texts collapsed to the first period of each.

A run is a stretch of words with smallest period q, at least max(LEAST, 2 q) long,
that no neighbouring word extends with that period. Words are
``[^\\x20\\x09-\\x0D]+``.

The texts of a slice are one sequence, each ended by a mark of its own that is
smaller than every word. In each slice

1. prefix doubling gives the suffix array; only suffixes that are still tied are
   sorted again, so ordinary prose takes three or four rounds;
2. the inverse array's next smaller value is where the longest Lyndon word that
   begins at a place ends, and its next larger value within the text where the longest
   one under the reversed order of words ends. By the runs theorem every run has a
   Lyndon root of one of these two kinds, whose length is the run's smallest period;
3. the roots are extended: to the right by the common prefix of the suffixes at both
   ends of the root, the least entry of the LCP array between them (a sparse table
   answers for all places at once), and to the left by a binary search over the same
   question. Roots that can't reach the least length are left after one question.

All of it is numpy within the task that reads the texts; nothing is shuffled. A
slice has about SLICE_BYTES, a longer text is a slice alone: memory is some
(40 + 8 log2 n) bytes for each of its n words.

A null or empty text has no words and no runs; the best run's columns are null, both
hashes are those of no bytes. Ties of the greatest length go to the smallest start,
then the smallest period. Repeated rows and null ids have results of their own.
Columns besides the id and the text are not read. Words are compared by 64-bit
hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship
from .words import Words, slices

LEAST = 12
SLICE_BYTES = 1 << 20
SCHEMA = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _new_group(*keys: np.ndarray) -> np.ndarray:
    """True where a sorted sequence differs from what stands before."""
    out = np.ones(len(keys[0]), bool)
    out[1:] = False
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    return out


def suffix_levels(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(suffix array, ranks by the first 1, 2, 4, ... symbols) of a sequence that has no two equal suffixes up to its marks.

    Equal ranks mean equal beginnings; the last ranks are all different.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    new = _new_group(symbols[order])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, span = [rank.astype(np.int32)], 1
    tied = order[~(new & np.append(new[1:], True))] if n else order
    while len(tied):
        after = tied + span
        key = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        by = np.lexsort((key, rank[tied]))
        tied, key = tied[by], key[by]
        old = rank[tied]
        group, part = _new_group(old), _new_group(old, key)
        place = np.arange(len(tied))
        offset = np.maximum.accumulate(np.where(part, place, 0)) - np.maximum.accumulate(np.where(group, place, 0))
        rank[tied] = old + offset
        levels.append(rank.astype(np.int32))
        tied = tied[~(part & np.append(part[1:], True))]
        span *= 2
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    return suffixes, levels


def common_prefixes(suffixes: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """lcp[r]: symbols that the suffixes of rank r-1 and r share at their beginnings."""
    out = np.zeros(len(suffixes), np.int32)
    left = np.flatnonzero(levels[0][suffixes[1:]] == levels[0][suffixes[:-1]]) + 1  # ranks whose neighbours share a symbol
    a, b, shared = suffixes[left - 1].copy(), suffixes[left].copy(), np.zeros(len(left), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = np.maximum(a, b) < len(suffixes)
        same = np.zeros(len(a), bool)
        same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
        a[same], b[same], shared[same] = a[same] + (1 << k), b[same] + (1 << k), shared[same] + (1 << k)
    out[left] = shared
    return out


class LeastBetween:
    """Range minima by a sparse table, and through them the common prefix of any two suffixes."""

    def __init__(self, lcp: np.ndarray, rank: np.ndarray):
        self.rank, self.rows, span = rank, [lcp], 1
        while 2 * span <= len(lcp):
            row = self.rows[-1]
            self.rows.append(np.minimum(row[:-span], row[span:]))
            span *= 2

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols that the suffixes at a and b, which differ, share at their beginnings."""
        ra, rb = self.rank[a], self.rank[b]
        low, high = np.minimum(ra, rb) + 1, np.maximum(ra, rb) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.zeros(len(a), np.int64)
        for k in np.unique(level):
            of = np.flatnonzero(level == k)
            row = self.rows[k]
            out[of] = np.minimum(row[low[of]], row[high[of] - (1 << k)])
        return out


def next_smaller(values: np.ndarray, rounds: int = 24) -> np.ndarray:
    """For each place the next one with a smaller value, of different ones; the length where there is none.

    Everything between a place and its pointer is larger, so a pointer at a larger
    value may jump to where that one's points. All places jump at once for some
    rounds; the few that are left (above long staircases) follow their pointers from
    the right, when all places behind them are done.
    """
    n = len(values)
    ended = np.append(values, np.iinfo(values.dtype).min)
    out = np.append(np.arange(1, n + 1), n)
    open_ = np.arange(n)
    for _ in range(rounds):
        open_ = open_[ended[out[open_]] > values[open_]]
        if not len(open_):
            return out[:n]
        out[open_] = out[out[open_]]
    open_ = open_[ended[out[open_]] > values[open_]]
    listed, found = ended.tolist(), out.tolist()
    for i in open_[::-1].tolist():
        v, j = listed[i], found[i]
        while listed[j] > v:
            j = found[j]
        found[i] = j
    return np.array(found[:n], np.int64)


def _reach_left(least: LeastBetween, i: np.ndarray, j: np.ndarray, room: np.ndarray) -> np.ndarray:
    """How many symbols before i equal those before j, at most ``room``."""
    low, high = np.zeros(len(i), np.int64), room.copy()
    while (open_ := low < high).any():
        of = np.flatnonzero(open_)
        middle = (low[of] + high[of] + 1) // 2
        good = least.common(i[of] - middle, j[of] - middle) >= middle
        low[of[good]] = middle[good]
        high[of[~good]] = middle[~good] - 1
    return low


def find_runs(h: np.ndarray, first: np.ndarray, fewest: int = LEAST) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of the runs of some texts' word hashes, by text, start and period; ``first`` has each text's first word and the end."""
    texts = len(first) - 1
    counts = np.diff(first)
    none = (np.zeros(0, np.int64),) * 4
    if not len(h):
        return none
    text_of = np.repeat(np.arange(texts), counts)
    at = np.arange(len(h)) + text_of  # a mark after each text
    marks = first[1:] + np.arange(texts)
    symbols = np.empty(len(h) + texts, np.int64)
    symbols[marks] = np.arange(texts)
    by = np.argsort(h)
    symbols[at[by]] = np.cumsum(_new_group(h[by])) - 1 + texts
    suffixes, levels = suffix_levels(symbols)
    rank = levels[-1].astype(np.int64)
    least = LeastBetween(common_prefixes(suffixes, levels), rank)
    end = marks[text_of]
    up, down = next_smaller(rank)[at], next_smaller(-rank)[at]
    inside = down < end  # else the word would hold the mark; runs up to the text's end have a root of the other kind
    i, j = np.concatenate([at, at[inside]]), np.concatenate([up, down[inside]])  # no pair twice: the next smaller value isn't larger
    period = j - i
    begin = first[:-1] + np.arange(texts)
    owner = np.searchsorted(marks, i)
    room = i - begin[owner]
    right = least.common(i, j)
    missing = np.maximum(fewest, 2 * period) - period - right
    can = missing <= room
    i, j, period, room, right, missing, owner = (x[can] for x in (i, j, period, room, right, missing, owner))
    need = np.maximum(missing, 0)
    can = np.ones(len(i), bool)
    ask = need > 0
    can[ask] = least.common(i[ask] - need[ask], j[ask] - need[ask]) >= need[ask]
    i, j, period, room, right, owner = (x[can] for x in (i, j, period, room, right, owner))
    left = _reach_left(least, i, j, room)
    found = np.stack([owner, i - left - begin[owner], left + period + right, period], 1)
    found = np.unique(found, axis=0)  # a run has a root in each of its periods
    by = np.lexsort((found[:, 3], found[:, 1], found[:, 0]))
    return tuple(found[by].T)


def _kept_texts(words: Words, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the kept words of all texts, one space between those of a text, and where each text begins."""
    edge = np.zeros(len(words.data) + 1, np.int8)
    edge[words.starts[kept]] += 1
    edge[words.ends[kept]] -= 1
    of = np.flatnonzero(kept)
    more = of[:-1][words.doc[of[:-1]] == words.doc[of[1:]]] if len(of) else of
    keep = np.cumsum(edge[:-1]) > 0
    data = np.where(keep, words.data, np.uint8(32))
    keep[words.ends[more]] = True  # a word that another one follows ends at white space
    return data[keep], np.append(0, np.cumsum(keep))[words.bounds]


def _results(words: Words, fewest: int) -> list[dict]:
    text, start, length, period = find_runs(words.hashes(), words.first, fewest)
    gone = np.zeros(len(words.starts) + 1, np.int64)
    np.add.at(gone, words.first[text] + start + period, 1)
    np.add.at(gone, words.first[text] + start + length, -1)
    data, begin = _kept_texts(words, np.cumsum(gone[:-1]) == 0)
    bounds = np.searchsorted(text, np.arange(len(words.counts) + 1))
    out = []
    for d in range(len(words.counts)):
        of = slice(bounds[d], bounds[d + 1])
        s, k, q = start[of], length[of], period[of]
        row: dict = {"n_runs": len(s), "start": None, "length": None, "period": None, "exponent_milli": None}
        if len(s):
            best = np.lexsort((q, s, -k))[0]
            row |= {"start": int(s[best]), "length": int(k[best]), "period": int(q[best]), "exponent_milli": int(1000 * k[best] // q[best])}
        runs = "".join(f"{a},{b},{c}\n" for a, b, c in zip(s.tolist(), k.tolist(), q.tolist(), strict=True))
        row["runs_sha256"] = hashlib.sha256(runs.encode()).hexdigest()
        row["collapsed_sha256"] = hashlib.sha256(data[begin[d] : begin[d + 1]].tobytes()).hexdigest()
        out.append(row)
    return out


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fewest: int = LEAST) -> DataFrame:
    """Per row: ``doc_id, n_runs``, the longest run's ``start, length, period, exponent_milli``, and the hashes of all runs and of the collapsed text."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shape = rows.sparkSession.createDataFrame([], f"doc_id {dict(rows.dtypes)['doc_id']}, {SCHEMA}").schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words in slices(batch.column(1), SLICE_BYTES):
                found = pa.Table.from_pylist(_results(words, fewest), pa.schema(list(arrow)[1:]))
                columns = [batch.column(0).slice(a, b - a).cast(arrow.field(0).type), *[c.combine_chunks() for c in found.columns]]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else c.chunk(0) for c in columns], schema=arrow)

    return rows.mapInArrow(run, shape)
