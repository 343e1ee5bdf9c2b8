"""Repeated passages: prefix-partitioned suffix trees over words.

A window is LENGTH consecutive words of one text; words are
``[^\\x20\\x09-\\x0D]+``. Every word that lies in a window whose words also start
anywhere else, in the same text or another, is removed. Windows are judged on
the input as it is.

1. One pass gives every text a 128-bit key of its word sequence, and cuts its
   windows into runs: the windows whose least hash of PREFIX consecutive words is
   the same place. Equal windows have that place at the same distance, so they
   meet under the same prefix; unequal ones mostly don't.
2. Texts with equal keys are one text with a count; all their windows repeat.
   Prefixes that only one run has can't hold a repeat and end here. Runs of equal
   words are one leaf with a count; those that aren't alone repeat as a whole, and
   one of them stands for all in the tree.
3. The words of the remaining runs go to the task of their prefix, where they make a
   subtree (small ones share a tree): all suffixes of the runs in order (ranks by prefix doubling) with the
   lengths of the prefixes that neighbours share. Neighbours that share at least
   LENGTH words lie below an internal node of that depth; a leaf's deepest such node
   gives the repeat that begins there, and of repeats that end alike in a run the
   longest is the maximal one.
4. A prefix whose group exceeds GROUP runs is lengthened: each window of its runs
   becomes a suffix of its own, and goes to the group of its first 11, 14, ... words,
   the fewest of which at most GROUP windows begin with. So groups stay within a
   task's memory. What has to be lengthened to the whole LENGTH words is a group of
   equal windows; those need no tree and are counted.
5. The repeats of a text are united and their words removed.

A null or empty text has no words: n_words 0, nothing removed, the hash of no
bytes. Texts of fewer than LENGTH words lose nothing. Rows with equal or null ids
are judged by their texts alone, each gets its own result; two rows with one
text are two places. Columns besides the id and the text are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ship
from .words import Words, grams, mix, slices

LENGTH, PREFIX, STEP = 35, 8, 3
#: Prefix lengths for windows whose anchor is too frequent for one tree; the last is the whole window.
LONGER = tuple(range(PREFIX + STEP, LENGTH + 1, STEP))
#: Runs of a group, and of a tree that groups share.
GROUP, TREE = 16384, 32768
CODE_BYTES = 5
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def sequence_keys(words: Words, h: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit keys of each text's word sequence."""
    place = np.arange(len(h)) - words.first[words.doc] if len(h) else np.zeros(0, np.int64)
    out = []
    for seed in (11, 12):
        total = np.append(np.uint64(0), np.cumsum(mix(h ^ mix(place.astype(np.uint64), seed), seed)))
        out.append(mix(total[words.first[1:]] - total[words.first[:-1]] + words.counts.astype(np.uint64), seed).view(np.int64))
    return out


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of an odd number, and of its inverse modulo 2**64."""
    base = 0xA0761D6478BD642F
    both = []
    for b in (base, pow(base, -1, 1 << 64)):
        out = np.full(n, np.uint64(b))
        out[0] = 1
        both.append(np.multiply.accumulate(out))
    return both[0], both[1]


def runs(words: Words, h: np.ndarray, length: int = LENGTH, prefix: int = PREFIX) -> tuple[np.ndarray, ...]:
    """(document, first window, number of windows, prefix hash, hash of all words) of the runs, in order; windows count from the text's start."""
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    if len(h) < length:
        return none
    value = grams(h, prefix, seed=31)
    at = np.arange(len(value), dtype=np.int32)
    span, need = 1, length - prefix + 1
    while span < need:
        step = min(span, need - span)
        m = len(value) - step
        left = value[:m] <= value[step:]
        value, at = np.where(left, value[:m], value[step:]), np.where(left, at[:m], at[step:])
        span += step
    start = np.arange(len(value))
    fits = start + length <= words.first[words.doc[start] + 1]
    start, value, at = start[fits], value[fits], at[fits]
    if not len(start):
        return none
    new = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (words.doc[start[1:]] != words.doc[start[:-1]])))
    count = np.diff(np.append(new, len(start)))
    doc = words.doc[start[new]]
    up, down = _powers(1 << len(h).bit_length())
    total = np.append(np.uint64(0), np.cumsum(mix(h, 17) * up[: len(h)]))
    first = start[new]
    content = mix((total[first + count + length - 1] - total[first]) * down[first] + count.astype(np.uint64), 19)
    return doc, first - words.first[doc], count, value[new], content


def normalised(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts with one space between words, and where each text begins."""
    last = np.zeros(len(words.starts), bool)
    last[words.first[1:][words.counts > 0] - 1] = True
    keep = words.inside.copy()
    keep[words.ends[~last]] = True
    data = np.where(words.inside, words.data, np.uint8(32))[keep]
    return data, np.append(0, np.cumsum(keep))[words.bounds]


SIGNED = "doc_id long, n_words long, key_a long, key_b long, sha256 string, starts array<int>, counts array<int>, prefixes array<long>, contents array<long>"


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, words in slices(batch.column(1)):
            h = words.hashes()
            data, at = normalised(words)
            view = memoryview(data)
            sha = [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            doc, start, count, value, content = runs(words, h)
            offsets = pa.array(np.append(0, np.cumsum(np.bincount(doc, minlength=j - i))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (start.astype(np.int32), count.astype(np.int32), value.view(np.int64), content.view(np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(words.counts), *map(pa.array, sequence_keys(words, h)), pa.array(sha), *lists], ["doc_id", "n_words", "key_a", "key_b", "sha256", "starts", "counts", "prefixes", "contents"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key_a, key_b, words): each text's words with one space between, compressed."""
    packer = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for i, j, words in slices(batch.column(0)):
            keep = words.counts >= LENGTH
            keys = [pa.array(k[keep]) for k in sequence_keys(words, words.hashes())]
            data, at = normalised(words)
            view = memoryview(data)
            packed = [packer.compress(view[at[d] : at[d + 1]]) for d in np.flatnonzero(keep).tolist()]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(packed, pa.binary())], ["key_a", "key_b", "words"])


def _text(content: pa.Scalar) -> bytes:
    return zstandard.ZstdDecompressor().decompress(content.as_buffer())


RUNS = "prefix long, key_a long, key_b long, start int, count int, codes binary, longer array<long>, window long"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each wanted run; of a run with a prefix too frequent for one tree, a row for each window with the hashes of its longer prefixes.

    Input: key_a, key_b, words, and the runs as array<struct<start, count, prefix, large>>.
    """
    for batch in batches:
        for k in range(len(batch)):
            text = np.frombuffer(_text(batch.column(2)[k]), np.uint8)
            words = Words(text, np.array([0, len(text)]))
            h = words.hashes()
            field = batch.column(3)[k].values
            start, count = field.field("start").to_numpy(), field.field("count").to_numpy()
            prefix, large = field.field("prefix").to_numpy(), field.field("large").to_numpy(zero_copy_only=False)
            codes = h.view(np.uint8).reshape(-1, 8)[:, :CODE_BYTES]
            cut = lambda at, n: codes[at : at + n + LENGTH - 1].tobytes()  # noqa: B023, E731
            out = [(int(prefix[r]), int(start[r]), int(count[r]), cut(start[r], count[r]), None, None) for r in np.flatnonzero(~large).tolist()]
            if large.any():
                last = len(h) - LENGTH + 1
                longer = np.stack([grams(h, n, 41)[:last] for n in LONGER], axis=1).view(np.int64)
                other = grams(h, LENGTH, 43).view(np.int64)
                for r in np.flatnonzero(large).tolist():
                    out += [(None, s, 1, cut(s, 1), longer[s].tolist(), int(other[s])) for s in range(int(start[r]), int(start[r]) + int(count[r]))]
            for low in range(0, len(out), 4096):
                part = out[low : low + 4096]
                columns = [pa.array([o[c] for o in part], t) for c, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.int64()))]
                keys = [pa.repeat(batch.column(c)[k], len(part)) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([columns[0], *keys, *columns[1:]], ["prefix", "key_a", "key_b", "start", "count", "codes", "longer", "window"])


class Subtree:
    """The suffix tree of runs of words, as its leaves in order and the depths of the nodes between them.

    codes: the words of all runs; bounds: where each begins and the last ends.
    order: the suffixes, by their words up to the run's end; shared[k]: how many
    words suffixes k and k + 1 of the order begin with alike, which is the depth of
    the lowest node above both.
    """

    def __init__(self, codes: np.ndarray, bounds: np.ndarray):
        n = len(codes)
        sizes = np.diff(bounds)
        self.room = np.repeat(bounds[1:], sizes) - np.arange(n)
        longest = int(sizes.max(initial=1))
        ranks, depth = [np.unique(codes, return_inverse=True)[1].astype(np.int32)], 1
        while depth < longest:  # ranks by the first 2, 4, 8, ... words; a run's end is less than any word
            rank = ranks[-1].astype(np.int64)
            follow = np.zeros(n, np.int64)
            follow[: n - depth] = rank[depth:] + 1
            follow[self.room <= depth] = 0
            ranks.append(np.unique(rank * (n + 2) + follow, return_inverse=True)[1].astype(np.int32))
            depth *= 2
        self.order = np.argsort(ranks[-1], kind="stable")
        a, b = self.order[:-1], self.order[1:]
        self.shared = np.zeros(max(n - 1, 0), np.int64)
        least = np.minimum(self.room[a], self.room[b])
        for level in range(len(ranks) - 1, -1, -1):
            size = 1 << level
            fits = self.shared + size <= least
            at = np.where(fits, self.shared, 0)
            self.shared += size * (fits & (ranks[level][a + at] == ranks[level][b + at]))

    def depths(self) -> np.ndarray:
        """For each suffix the depth of the deepest node above its leaf: how many of its words begin another suffix too."""
        out = np.zeros(len(self.order), np.int64)
        either = np.maximum(np.append(0, self.shared), np.append(self.shared, 0))[: len(self.order)]
        out[self.order] = either
        return out


def maximal_repeats(codes: np.ndarray, bounds: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(places, words) of the repeats of at least ``length`` words that begin no earlier in their run."""
    depth = Subtree(codes, bounds).depths()
    depth[depth < length] = 0
    inner = np.zeros(len(depth), bool)  # the rest of the repeat that begins a word before
    inner[1:] = (depth[1:] > 0) & (depth[:-1] == depth[1:] + 1)
    inner[bounds[:-1]] = False
    places = np.flatnonzero((depth > 0) & ~inner)
    return places, depth[places]


SPANS = "key_a long, key_b long, start int, words int"


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (prefix, key_a, key_b, start, count, codes) sorted by prefix: the repeats of each run."""
    held: list[pa.RecordBatch] = []

    def solve(rows: pa.Table) -> pa.RecordBatch | None:
        counts = rows.column("count").to_numpy().astype(np.int64)
        flat = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint8).reshape(-1, CODE_BYTES)
        wide = np.zeros((len(flat), 8), np.uint8)
        wide[:, :CODE_BYTES] = flat
        bounds = np.append(0, np.cumsum(counts + LENGTH - 1))
        # Small groups share one tree: windows of different prefixes differ, so they only hang beside each other.
        places, words = maximal_repeats(wide.view(np.uint64).ravel(), bounds)
        if not len(places):
            return None
        run = np.searchsorted(bounds, places, "right") - 1
        start = rows.column("start").to_numpy()[run] + (places - bounds[run])
        return pa.RecordBatch.from_arrays([*(rows.column(c).take(pa.array(run)).combine_chunks() for c in ("key_a", "key_b")), pa.array(start.astype(np.int32)), pa.array(words.astype(np.int32))], ["key_a", "key_b", "start", "words"])

    size = 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        size += len(batch)
        if size < TREE:
            continue
        rows = pa.Table.from_batches(held)
        prefix = rows.column("prefix").to_numpy()
        cut = int(np.searchsorted(prefix, prefix[-1], "left"))  # the last prefix may go on
        if cut:
            if (out := solve(rows.slice(0, cut))) is not None:
                yield out
            held, size = rows.slice(cut).to_batches(), len(rows) - cut
    if held and (out := solve(pa.Table.from_batches(held))) is not None:
        yield out


def lengthened(windows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(rows for trees, repeats) of single windows whose anchor was too frequent: each under its shortest prefix that at most GROUP windows have."""
    names = ("prefix", "key_a", "key_b", "start", "count", "codes")
    trees = windows.where("false").select(*names)
    for level in range(len(LONGER) - 1):
        if windows.isEmpty():
            break
        windows = windows.withColumn("prefix", F.col("longer")[level])
        sizes = scratch.cut(windows.groupBy(F.col("prefix").alias("of")).agg(F.count(F.lit(1)).alias("n")), "sizes")
        fit = windows.join(sizes.where(F.col("n").between(2, GROUP)), F.col("prefix") == F.col("of"))
        # Prefixes of different lengths are different groups.
        trees = trees.unionByName(fit.withColumn("prefix", F.xxhash64("prefix", F.lit(LONGER[level]))).select(*names))
        windows = scratch.cut(windows.join(sizes.where(F.col("n") > GROUP), F.col("prefix") == F.col("of")).drop("of", "n"), "longer")
    whole = windows.select("key_a", "key_b", "start", F.col("longer")[len(LONGER) - 1].alias("a"), F.col("window").alias("b"))
    again = scratch.cut(whole.groupBy(F.col("a").alias("of_a"), F.col("b").alias("of_b")).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "again")
    repeats = whole.join(again, (F.col("a") == F.col("of_a")) & (F.col("b") == F.col("of_b")))
    return trees, repeats.select("key_a", "key_b", "start", F.lit(LENGTH).alias("words"))


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key_a, key_b, words, repeats) to the number of removed words and what is left."""
    for batch in batches:
        removed, left = [], []
        for k in range(len(batch)):
            words = _text(batch.column(2)[k]).split(b" ")
            cover = np.zeros(len(words) + 1, np.int32)
            field = batch.column(3)[k].values
            start = field.field("start").to_numpy().astype(np.int64)
            np.add.at(cover, start, 1)
            np.add.at(cover, start + field.field("words").to_numpy(), -1)
            gone = np.cumsum(cover[:-1]) > 0
            removed.append(int(gone.sum()))
            left.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in left]), pa.array(left, pa.binary()).cast(pa.string())], ["key_a", "key_b", "removed", "left_sha256", "left_text"])


def repeats(docs: DataFrame, id_col: str, text_col: str, with_text: bool) -> tuple[DataFrame, DataFrame]:
    """(a row for each input row with its text's keys and counts, a row for each text that loses some words)."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "substrings")
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = scratch.cut(text.mapInArrow(_signed, SIGNED), "signed")
    long_ = signed.where(F.col("n_words") >= LENGTH)
    # Counts are written before they are joined: Spark can then split the join's large keys, which it can't below an aggregate.
    copies = scratch.cut(long_.groupBy("key_a", "key_b").agg(F.count(F.lit(1)).alias("copies")), "copies")
    once = long_.groupBy("key_a", "key_b").agg(F.first(F.arrays_zip("starts", "counts", "prefixes", "contents")).alias("runs"))
    r = lambda c: F.col(f"r.{c}")
    found = once.select("key_a", "key_b", F.explode("runs").alias("r")).select("key_a", "key_b", r("starts").alias("start"), r("counts").alias("count"), r("prefixes").alias("prefix"), r("contents").alias("content"))
    found = scratch.cut(found, "runs")
    frequent = scratch.cut(found.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("prefix"), "frequent")
    shared = scratch.cut(found.join(frequent, "prefix"), "shared")
    scratch.drop(found)
    # Runs of equal words are one leaf of the tree; all windows of a run that isn't alone repeat.
    distinct = shared.groupBy("prefix", "content").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key_a", "key_b", "start", "count")).alias("one"))
    distinct = scratch.cut(distinct, "distinct")
    equal = scratch.cut(shared.join(distinct.where("n > 1").select("prefix", "content"), ["prefix", "content"]).select("key_a", "key_b", "start", (F.col("count") + LENGTH - 1).alias("words")), "equal")
    scratch.drop(shared)
    branches = scratch.cut(distinct.groupBy("prefix").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "branches")
    leaves = distinct.join(branches, "prefix").select("one.key_a", "one.key_b", F.struct(F.col("one.start").alias("start"), F.col("one.count").alias("count"), "prefix", (F.col("k") > GROUP).alias("large")).alias("run"))
    none = equal.select("key_a", "key_b", F.lit(None).cast(leaves.schema["run"].dataType).alias("run"))
    wanted = leaves.unionByName(none).groupBy("key_a", "key_b").agg(F.collect_list("run").alias("runs"))
    # One of the texts with a key is enough: it comes with its words, for the trees and for what is left.
    packed = text.select("text").mapInArrow(_packed, "key_a long, key_b long, words binary").groupBy("key_a", "key_b").agg(F.first("words").alias("words"))
    held = scratch.cut(packed.join(wanted, ["key_a", "key_b"]).select("key_a", "key_b", "words", "runs"), "held")
    scratch.drop(distinct)
    spread = held.mapInArrow(_runs, RUNS)
    spread = scratch.cut(spread, "spread")
    trees = spread.where("prefix is not null").select("prefix", "key_a", "key_b", "start", "count", "codes")
    more, whole = lengthened(spread.where("prefix is null"), scratch)
    trees = trees.unionByName(more).repartition("prefix").sortWithinPartitions("prefix").mapInArrow(_trees, SPANS)
    spans = trees.unionByName(whole).unionByName(equal).groupBy("key_a", "key_b").agg(F.collect_list(F.struct("start", "words")).alias("repeats"))
    spans = scratch.cut(spans, "spans")
    scratch.drop(spread)
    # All words of a text with copies go, so only the others need their words again.
    some = copies.where("copies = 1").join(spans, ["key_a", "key_b"]).select("key_a", "key_b", "repeats")
    stripped = held.select("key_a", "key_b", "words").join(some, ["key_a", "key_b"]).select("key_a", "key_b", "words", "repeats")
    stripped = stripped.mapInArrow(_strip, "key_a long, key_b long, removed long, left_sha256 string, left_text string")
    if not with_text:
        stripped = stripped.drop("left_text")
    return signed.join(copies, ["key_a", "key_b"], "left"), scratch.cut(stripped, "stripped")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for each row of ``docs``.

    with_text adds ``kept_text``: the words that are left, with one space between,
    for rows that lose some; null for the others, whose text stays as it is.
    """
    rows, stripped = repeats(docs, id_col, text_col, with_text)
    all_gone = F.coalesce(F.col("copies") > 1, F.lit(False))
    out = rows.join(stripped, ["key_a", "key_b"], "left")
    return out.select(
        "doc_id",
        "n_words",
        F.when(all_gone, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(all_gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("left_sha256", "sha256")).alias("kept_sha256"),
        *([F.when(all_gone, F.lit("")).otherwise(F.col("left_text")).alias("kept_text")] if with_text else []),
    )
