"""Benchmark decontamination: CGK embeddings, repeated bit sampling, exact edit verification.

A document leaks an item if some run of its tokens is within ``floor(EDIT_RATE x
tokens of the item)`` insertions, deletions and substitutions of the item's.
Tokens are lower-cased alphanumeric runs; an item of fewer than five tokens has no
edits to spare, so documents that hold it word for word leak it.

1. Windows. For each length that an item has, windows of so many tokens are laid
   over the document. Most need not be looked at: an item is cut into one more
   piece than it may have edits, so a leak holds at least one piece unchanged, and
   only windows in which some item's piece lies in its place are embedded. This
   prefilter loses no leak.
2. The Chakraborty-Goldenberg-Koucky walk copies a window into a string three
   times as long, stepping on or not by a random bit of (place, token); edits
   become mismatches, and what is alike comes back in step. WALKS walks are made.
3. Bit sampling. Each walk has TABLES tables, each with SAMPLED (or SAMPLED_SHORT) places of its own.
   The places lie where the walks of a window of that length still are within it
   (``sampled_places``), so padding decides nothing; where a walk has ended
   early, its padding differs from any item's. An item and a window of one length
   are candidates if they share a bucket, that is all its sampled symbols, of some
   table. A pair whose walks agree in a share ``a`` of the places is found with
   1 - (1 - a**SAMPLED)**TABLES for each walk. Over unrelated tokens ``a`` is the
   chance that two tokens are equal, so almost nothing passes; tests measure both
   rates (README has them).
4. A candidate is verified on the tokens around it by the exact edit distance to
   the best run of tokens.

The items are the stated query set: they go to the executors in blocks of at most
BLOCK_ITEMS items and BLOCK_BYTES bytes, each block against all documents, so time
grows with the number of blocks. Every
document is searched in full, in the task that reads it; nothing is shuffled.

Null and empty texts leak nothing, null and empty items (or of no token) are
leaked by none. Rows with equal or null ids are searched one by one. Equal rows of
items are one item. Columns besides ids and texts are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plain_names, ship
from .tokens import AlnumTokens, alnum_hashes, alnum_slices
from .words import grams, mix

EDIT_RATE = 0.2
WALKS, TABLES = 8, 24
#: Places in a sample, for windows of fewer than SHORT tokens and for others: fewer tokens agree by chance more easily.
SAMPLED_SHORT, SAMPLED, SHORT = 6, 4, 24
BLOCK_ITEMS, BLOCK_BYTES = 4000, 4 << 20
MAX_SEED = 4
PAIR_CELLS = 1 << 20
_KEY = np.uint64(0xD6E8FEB86659FD93)


def sampled_places(length: int) -> np.ndarray:
    """(WALKS, TABLES, samples) places in the walks of strings of ``length`` tokens.

    A walk takes two steps a token on average. The first ``length`` places always lie
    within the string; of long ones, places up to 2 length less three standard
    deviations do too.
    """
    reach = max(length, int(2 * length - 4.3 * length**0.5))
    samples = max(SAMPLED, min(SAMPLED_SHORT, length - 2)) if length < SHORT else SAMPLED
    order = np.random.default_rng([7, length]).random((WALKS, TABLES, max(reach, samples))).argsort(axis=2)
    return order[:, :, :samples] % reach  # different ones, where there are so many


def walk(rows: np.ndarray, lengths: np.ndarray, steps: int, ended: int) -> np.ndarray:
    """(rows, WALKS, steps) 16-bit symbols of the walks over rows of tokens; ``ended`` stands behind a walk's end."""
    n, width = rows.shape
    out = np.full((n, WALKS, steps), ended, np.uint16)
    bits = mix(rows, 5)  # WALKS x place bits are drawn from this and the place
    symbols = (bits >> np.uint64(20)).astype(np.uint16) | np.uint16(2)  # 0 and 1 are for ends
    at = np.zeros((n, WALKS), np.int64)
    row = np.arange(n)[:, None]
    last = lengths[:, None]
    shift = (np.arange(WALKS, dtype=np.uint64) * np.uint64(3))[None, :]
    for j in range(steps):
        inside = at < last
        here = np.minimum(at, width - 1)
        np.copyto(out[:, :, j], symbols[row, here], where=inside)
        coin = mix(bits[row, here] ^ np.uint64((j + 1) * int(_KEY) & 0xFFFFFFFFFFFFFFFF), 3)
        at += inside & ((coin >> shift) & np.uint64(1)).astype(bool)
    return out


def buckets(walks: np.ndarray, places: np.ndarray) -> np.ndarray:
    """(rows, WALKS x TABLES) keys of the buckets; a key tells its table."""
    n, samples = len(walks), places.shape[2]
    key = np.arange(WALKS * TABLES, dtype=np.uint64)[None, :].repeat(n, 0)
    flat = places.reshape(WALKS, TABLES * samples)
    picked = np.take_along_axis(walks, np.broadcast_to(flat, (n, *flat.shape)), axis=2).reshape(n, WALKS * TABLES, samples)
    for k in range(samples):
        key = key * _KEY + picked[:, :, k]
        key ^= key >> np.uint64(31)
    return key


class Length:
    """The tables of the items of one length: sorted bucket keys and the items in them."""

    def __init__(self, length: int, numbers: np.ndarray, tokens: np.ndarray):
        self.length, self.places = length, sampled_places(length)
        self.steps = int(self.places.max()) + 1
        key = buckets(walk(tokens, np.full(len(tokens), length), self.steps, 0), self.places)
        item = np.broadcast_to(numbers[:, None], key.shape).ravel()
        order = np.argsort(key, axis=None, kind="stable")
        self.key, self.item = key.ravel()[order], item[order]
        self.seen = np.zeros(1 << 16, bool)
        self.seen[self.key & np.uint64(0xFFFF)] = True

    def candidates(self, rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, item) that share a bucket."""
        key = buckets(walk(rows, lengths, self.steps, 1), self.places)
        row, column = np.nonzero(self.seen[key & np.uint64(0xFFFF)])
        value = key[row, column]
        low, high = np.searchsorted(self.key, value, "left"), np.searchsorted(self.key, value, "right")
        count = high - low
        which = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - low, count)
        pair = np.unique(np.stack([np.repeat(row, count), self.item[which]]), axis=1)
        return pair[0], pair[1]


class Index:
    """Pieces and tables of a block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.tokens = [], []
        for ident, text in items:
            h = alnum_hashes(text)
            if len(h):
                self.ids.append(ident)
                self.tokens.append(h)
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.edits = np.floor(self.lengths * EDIT_RATE + 1e-9).astype(np.int64)
        seeds: dict[int, set[tuple[int, int, int]]] = {}
        for h, edits in zip(self.tokens, self.edits.tolist(), strict=True):
            size = min(MAX_SEED, len(h) // (edits + 1))
            g = grams(h, size, 71)
            for piece in range(edits + 1):
                at = piece * len(h) // (edits + 1)
                seeds.setdefault(size, set()).add((int(g[at]), len(h), at))
        self.seeds = {}
        for size, found in seeds.items():
            found = sorted(found)
            value = np.array([f[0] for f in found], np.uint64)
            table = np.zeros(1 << 20, bool)
            table[value & np.uint64((1 << 20) - 1)] = True
            self.seeds[size] = (value, np.array([f[1] for f in found]), np.array([f[2] for f in found]), table)
        self.by_length = {}
        for length in np.unique(self.lengths).tolist():
            numbers = np.flatnonzero(self.lengths == length)
            self.by_length[length] = Length(length, numbers, np.stack([self.tokens[k] for k in numbers]))

    def windows(self, tokens: AlnumTokens, h: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(length, starts) of the windows in which a piece of an item of that length lies in its place."""
        starts, lengths = [], []
        for size, (value, length, at, table) in self.seeds.items():
            g = grams(h, size, 71)
            maybe = np.flatnonzero(table[g & np.uint64((1 << 20) - 1)])
            low, high = np.searchsorted(value, g[maybe], "left"), np.searchsorted(value, g[maybe], "right")
            count = high - low
            place = np.repeat(maybe, count)
            which = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - low, count)
            fits = place + size <= tokens.first[tokens.doc[place] + 1]
            place, which = place[fits], which[fits]
            starts.append(np.maximum(place - at[which], tokens.first[tokens.doc[place]]))
            lengths.append(length[which])
        if not starts:
            return
        pair = np.unique(np.stack([np.concatenate(lengths), np.concatenate(starts)]), axis=1)
        for length in np.unique(pair[0]).tolist():
            yield length, pair[1][pair[0] == length]


def best_run(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(edits, first, end) of the run of ``text`` that is nearest to ``item``; the shortest, then the first of equals."""
    n = len(text)
    place = np.arange(n + 1)
    cost = np.zeros(n + 1, np.int64)
    # cost, then the run's length, in one number: the least of it is the nearest and shortest run.
    scale = np.int64(1 << 32)
    value = cost * scale
    for token in item.tolist():
        up = value + scale
        across = value[:-1] + np.where(text == np.uint64(token), 0, scale) + 1
        new = up.copy()
        np.minimum(new[1:], across, out=new[1:])
        step = scale + 1
        new = np.minimum.accumulate(new - place * step) + place * step
        value = new
    end = int(np.argmin(value))
    edits, length = divmod(int(value[end]), int(scale))
    return edits, end - length, end


def candidates(index: Index, tokens: AlnumTokens, h: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, item number) of the windows that share a bucket with an item."""
    for length, start in index.windows(tokens, h):
        tables = index.by_length[length]
        block = max(1, PAIR_CELLS // (WALKS * (tables.steps + tables.places[0].size)))
        for k in range(0, len(start), block):
            s = start[k : k + block]
            size = np.minimum(length, tokens.first[tokens.doc[s] + 1] - s)
            rows = h[np.minimum(s[:, None] + np.arange(length)[None, :], len(h) - 1)]
            row, item = tables.candidates(rows, size)
            yield from zip(s[row].tolist(), item.tolist(), strict=True)


def _search(index: Index, tokens: AlnumTokens) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, item number, edits, first token, end token) of all leaks in a run of texts."""
    h = tokens.hashes(lower=True)
    seen: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for s, m in candidates(index, tokens, h):
        doc = int(tokens.doc[s])
        edits, size = int(index.edits[m]), int(index.lengths[m])
        low, high = max(int(tokens.first[doc]), s - edits), min(int(tokens.first[doc + 1]), s + size + 2 * edits)
        spans = seen.setdefault((doc, m), [])
        if any(a <= s < b for a, b in spans):
            continue
        far, first, end = best_run(index.tokens[m], h[low:high])
        if far > edits:
            continue
        first, end = first + low, end + low
        if any(a < end and first < b for a, b in spans):
            continue
        spans.append((first, end))
        yield doc, m, far, first, end


LEAKS = "doc_id long, item_id long, edits long, item_tokens long, start long, end long, passage string"


def _leaks(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value)
        names = ["doc_id", "item_id", "edits", "item_tokens", "start", "end", "passage"]
        kinds = [pa.int64()] * 6 + [pa.string()]
        for batch in batches:
            out = []
            for i, j, tokens in alnum_slices(batch.column(1)):
                for doc, m, edits, first, end in _search(index, tokens):
                    out.append((batch.column(0)[i + doc].as_py(), index.ids[m], edits, int(index.lengths[m]), *tokens.span(doc, first, end - 1)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return run


def _clean(shared, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value)
        for batch in batches:
            keep = np.ones(len(batch), bool)
            for i, _, tokens in alnum_slices(batch.column(column)):
                for doc, *_ in _search(index, tokens):
                    keep[i + doc] = False
            yield batch.filter(pa.array(keep))

    return run


def item_blocks(docs: DataFrame, benchmark: DataFrame) -> list:
    """Broadcast variables that hold the items, each of bounded size.

    A block is as wide as its longest item, so where the items together are too
    large, those of like length share blocks.
    """
    spark = docs.sparkSession
    ship(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    items = items.withColumn("size", F.ceil(F.log2(F.octet_length("text") + 2)).cast("int"))
    sizes = {r["size"]: r["n"] for r in items.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    total, longest = sum(sizes.values()), 2 ** max(sizes, default=0)
    if total <= BLOCK_ITEMS and total * longest <= BLOCK_BYTES:
        parts = [items]
    else:
        parts = []
        for size, n in sorted(sizes.items()):
            blocks = max(-(-n // (BLOCK_ITEMS // 2)), -(-n * 2**size // (BLOCK_BYTES // 2)))
            of = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
            parts += [items.where((F.col("size") == size) & (of == block)) for block in range(blocks)]
    return [spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in part.collect()]) for part in parts]


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each passage of ``docs`` that leaks an item of ``benchmark`` (item_id, text).

    ``doc_id, item_id, edits, item_tokens, start, end, passage``; start and end are code points of the text.
    """
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for shared in item_blocks(docs, benchmark):
        found = text.mapInArrow(_leaks(shared), LEAKS)
        out = found if out is None else out.unionByName(found)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that leak no item, with all their columns, without a shuffle."""
    at = docs.columns.index(text_col)
    out = docs
    for shared in item_blocks(docs, benchmark):
        out = plain_names(out).mapInArrow(_clean(shared, at), docs.schema)
    return out
