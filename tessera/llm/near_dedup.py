"""MinHash near-duplicates: fast similarity sketching, banding, exact verification.

A document's set holds its distinct five-word shingles (A-Z lower-cased, words
``[^\\x20\\x09-\\x0D]+``); with one to four words the whole sequence is its one
element; without words it is empty and linked with nothing. Two documents are
linked if their Jaccard similarity is at least 0.75.

1. One pass over the texts gives each document a 128-bit key of its set and a
   sketch. The sketch has T coordinates and is filled in rounds: in round i < T
   every element is hashed into one random bin with the value (i, hash), in
   round T + b every element goes to bin b; a bin keeps its least value, and
   the rounds end when all bins are full. So every coordinate fills, in
   O(T log T + |set|) steps, and the similarity estimate is concentrated as
   with T independent hash functions.
2. Documents with equal keys are one class; its smallest id stands for it.
3. BANDS bands of ROWS coordinates make buckets. At similarity 0.75 a pair shares
   no bucket with a probability of (1 - 0.75**ROWS)**BANDS = 7e-6.
4. Classes that buckets connect form a candidate group. The sets of the classes
   in groups of two or more are compared on full sets, inside a task: all pairs
   of a group of up to BLOCK classes and ELEMENTS elements.
5. A larger group is contracted first. Each class is compared with the hub (the
   least id) of each of its buckets, in chunks that hold one hub's set and read the
   others one by one; that grows with the number of classes. What is linked so is
   one component. Only buckets that still hold several components go on: the
   classes outside a bucket's largest component are dealt to blocks, and each block
   is compared with the rest of the bucket, which streams past it. So a group of
   near copies costs in proportion to its size, and all pairs are compared only of
   what isn't linked.
6. Only a spanning forest of the links leaves a task, so neither a group of copies
   nor a large group of near copies turns into all its pairs.

Null and empty texts have no set, stay, and are their own component. A null
doc_id is linked with nothing and has a null component_id; its row is kept.
Rows that repeat a doc_id are one node: their links join one component.
Columns besides doc_id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components, ship
from .words import Words, grams, mix, slices

WIDTH = 5
BANDS, ROWS = 44, 5
BINS = BANDS * ROWS
BLOCK, CHUNK = 512, 256
ELEMENTS = 2 << 20
NUMERATOR, DENOMINATOR = 3, 4


def shingles(words: Words, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(document, element) of all sets, by document and then by element."""
    h = words.hashes(lower=True)
    windows = grams(h, width)
    start = np.arange(len(windows))
    fits = start + width <= words.first[words.doc[start] + 1] if len(start) else np.zeros(0, bool)
    doc, value = words.doc[start[fits]], windows[fits]
    short = np.flatnonzero((words.counts > 0) & (words.counts < width))
    if len(short):
        whole = [grams(h[words.first[i] : words.first[i + 1]], int(words.counts[i]), seed=7)[0] for i in short]
        doc, value = np.append(doc, short), np.append(value, np.array(whole, np.uint64))
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    if len(doc):
        new = np.append(True, (doc[1:] != doc[:-1]) | (value[1:] != value[:-1]))
        doc, value = doc[new], value[new]
    return doc, value


def sketch(doc: np.ndarray, value: np.ndarray, n: int, bins: int = BINS) -> np.ndarray:
    """n x bins values; rows of documents without elements hold the largest value."""
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(n * bins, empty, np.uint64)
    for turn in range(2 * bins):
        if not len(doc):
            break
        h = mix(value, turn + 1)
        at = (h >> np.uint64(40)) % np.uint64(bins) if turn < bins else np.uint64(turn - bins)
        np.minimum.at(out, doc * bins + (at.astype(np.int64) if turn < bins else int(at)), (np.uint64(turn) << np.uint64(48)) | (mix(h) >> np.uint64(16)))
        open_ = (out.reshape(n, bins) == empty).any(axis=1)
        keep = open_[doc]
        doc, value = doc[keep], value[keep]
    return out.reshape(n, bins)


SIGNED = "doc_id long, n_shingles long, key_a long, key_b long, bands array<long>"


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, words in slices(batch.column(1)):
            n = j - i
            doc, value = shingles(words)
            size = np.bincount(doc, minlength=n)
            keys = []
            for seed in (101, 202):
                total = np.zeros(n + 1, np.uint64)
                np.cumsum(np.append(np.uint64(0), mix(value, seed)), out=(run := np.empty(len(value) + 1, np.uint64)))
                at = np.append(0, np.cumsum(size))
                total = run[at[1:]] - run[at[:-1]]
                keys.append(mix(total, seed).view(np.int64))
            full = sketch(doc, value, n)
            band = np.full((n, BANDS), 0, np.uint64)
            for r in range(ROWS):
                band = mix(band * np.uint64(0xD6E8FEB86659FD93) + full[:, r::ROWS], 3)
            band = mix(band + np.arange(BANDS, dtype=np.uint64)[None, :], 5)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(band.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), pa.array(size), pa.array(keys[0]), pa.array(keys[1]), bands], ["doc_id", "n_shingles", "key_a", "key_b", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Full sets as sorted little-endian 64-bit values."""
    for batch in batches:
        for i, j, words in slices(batch.column(1)):
            doc, value = shingles(words)
            at = np.append(0, np.cumsum(np.bincount(doc, minlength=j - i))).astype(np.int64) * 8
            content = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(value.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), content.cast(pa.binary())], ["doc_id", "elements"])


def _shared(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """How many elements each of ``left`` has in common with each of ``right`` (None: of ``left``).

    From a common dictionary: classes in the postings of an element are counted
    together, never emitted. Elements of one class alone are left out.
    """
    both = left if right is None else [*left, *right]
    owner = np.repeat(np.arange(len(both)), [len(x) for x in both])
    _, code, often = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    common = often[code] > 1
    code, owner = (np.cumsum(often > 1) - 1)[code[common]], owner[common]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    n, width = len(both), int((often > 1).sum())
    out = np.zeros((len(left), n - len(left) if right is not None else n), np.float32)
    step = max(1, (8 << 20) // (4 * n))
    for low in range(0, width, step):
        a, b = np.searchsorted(code, (low, low + step))
        table = np.zeros((n, min(step, width - low)), np.float32)
        table[owner[a:b], code[a:b] - low] = 1
        out += table[: len(left)] @ (table if right is None else table[len(left) :]).T
    return out


class _Task:
    """The links of one task: a block of classes, compared with each other and with those that come after."""

    def __init__(self) -> None:
        self.left: list[tuple[int, int, np.ndarray]] = []  # component, id, set
        self.right: list[tuple[int, int, np.ndarray]] = []
        self.root: dict[int, int] = {}
        self.found: list[tuple[int, int]] = []
        self.held = 0

    def _find(self, v: int) -> int:
        while self.root.setdefault(v, v) != v:
            self.root[v] = v = self.root[self.root[v]]
        return v

    def _link(self, some: list, others: list, shared: np.ndarray) -> None:
        a, b = (np.array([len(x[2]) for x in rows], np.float32) for rows in (some, others))
        linked = DENOMINATOR * shared >= NUMERATOR * (a[:, None] + b[None, :] - shared)
        linked &= np.array([x[0] for x in some])[:, None] != np.array([x[0] for x in others])[None, :]
        for p, q in zip(*(x.tolist() for x in np.nonzero(np.triu(linked, 1) if some is others else linked)), strict=True):
            x, y = self._find(some[p][0]), self._find(others[q][0])
            if x != y:
                self.root[max(x, y)] = min(x, y)
                self.found.append((some[p][1], others[q][1]))

    def add(self, role: int, row: tuple[int, int, np.ndarray]) -> None:
        """Rows of role 0, the block, come first."""
        if role == 0:
            self.left.append(row)
            return
        if not self.right and not self.held:
            self.inside()
        self.right.append(row)
        self.held += len(row[2])
        if len(self.right) >= CHUNK or self.held >= ELEMENTS:
            self.across()

    def inside(self) -> None:
        self.held = 1
        if len(self.left) > 1:
            self._link(self.left, self.left, _shared([x[2] for x in self.left], None))

    def across(self) -> None:
        if self.right and self.left:
            self._link(self.left, self.right, _shared([x[2] for x in self.left], [x[2] for x in self.right]))
        self.right, self.held = [], 1

    def done(self) -> list[tuple[int, int]]:
        if not self.held:
            self.inside()
        self.across()
        return self.found


TASKS = ("kind", "task", "pair", "role")


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (kind, task, pair, role, component, doc_id, elements) sorted by the first four: the links of each task."""
    at, task = None, _Task()

    def out(found: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(6)]
        for kind, number, pair, role, component, ident, content in zip(*columns, batch.column(6), strict=True):
            if (kind, number, pair) != at:
                yield from out(task.done())
                at, task = (kind, number, pair), _Task()
            task.add(role, (component, ident, np.frombuffer(content.as_buffer(), np.uint64)))
    yield from out(task.done())


def _compared(docs: DataFrame, tasks: DataFrame, scratch: Scratch, id_col: str, text_col: str, label: str) -> DataFrame:
    """The links (a, b) that the tasks (kind, task, pair, role, component, rep) find on full sets."""
    tasks = scratch.cut(tasks.select(*TASKS, "component", "rep"), "tasks")
    wanted = tasks.select(F.col("rep").alias("_rep")).distinct()
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(wanted, F.col("doc_id") == F.col("_rep"), "left_semi")
    sets = text.mapInArrow(_sets, "doc_id long, elements binary")
    rows = tasks.join(sets, F.col("rep") == F.col("doc_id")).select(*TASKS, "component", "doc_id", "elements")
    rows = rows.repartition(*TASKS[:3]).sortWithinPartitions(*TASKS, "doc_id")
    return scratch.cut(rows.mapInArrow(_verify, "a long, b long"), label)


def _contracted(docs: DataFrame, full: DataFrame, scratch: Scratch, id_col: str, text_col: str) -> DataFrame:
    """The links of large groups: first between classes and hubs, then between components that a bucket still holds.

    full: rep, size, band, bucket, hub of all classes of the large groups.
    """
    pairs = scratch.cut(full.where("rep <> hub").select("hub", "rep").distinct(), "stars")
    chunks = scratch.cut(pairs.groupBy(F.col("hub").alias("of")).agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks")), "chunks")
    chunk = F.pmod(F.xxhash64("rep", F.lit("chunk")), F.col("chunks")).cast("long")
    members = pairs.join(chunks, F.col("hub") == F.col("of")).select(F.lit(0).alias("kind"), F.col("hub").alias("task"), chunk.alias("pair"), F.lit(1).alias("role"), "rep")
    heads = chunks.select(F.lit(0).alias("kind"), F.col("of").alias("task"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks").cast("long") - 1)).alias("pair"), F.lit(0).alias("role"), F.col("of").alias("rep"))
    stars = _compared(docs, members.unionByName(heads).withColumn("component", F.col("rep")), scratch, id_col, text_col, "star-links")
    roots = connected_components(stars, scratch)
    held = scratch.cut(full.join(roots, F.col("rep") == F.col("id"), "left").select("rep", "size", "band", "bucket", F.coalesce("root", "rep").alias("component")), "contracted")
    parts = held.groupBy("band", "bucket", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    open_ = parts.groupBy(F.col("band").alias("b"), F.col("bucket").alias("u")).agg(
        F.max_by("component", F.struct("n", "component")).alias("largest"), F.max(F.struct("n", "component", "size")).alias("top"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("k")
    ).where("k > 1")
    blocks = F.greatest(F.ceil((F.col("n") - F.col("top.n")) / CHUNK), F.ceil((F.col("size") - F.col("top.size")) / ELEMENTS)).cast("int")
    open_ = scratch.cut(open_.select("b", "u", "largest", blocks.alias("blocks")), "open")
    rest = held.join(open_, (F.col("band") == F.col("b")) & (F.col("bucket") == F.col("u")))
    rest = rest.withColumn("part", F.when(F.col("component") == F.col("largest"), F.col("blocks")).otherwise(F.pmod(F.xxhash64("rep", F.lit("block")), F.col("blocks"))).cast("int"))
    met = rest.withColumn("at", F.explode(F.sequence(F.lit(0), F.least(F.col("part"), F.col("blocks") - 1))))
    tasks = met.select((F.col("band") + 1).alias("kind"), F.col("bucket").alias("task"), F.col("at").cast("long").alias("pair"), F.when(F.col("at") == F.col("part"), 0).otherwise(1).alias("role"), "component", "rep")
    return stars.unionByName(_compared(docs, tasks, scratch, id_col, text_col, "rest-links"))


def links(docs: DataFrame, signed: DataFrame, scratch: Scratch, id_col: str, text_col: str) -> DataFrame:
    """Edges ``(a, b)`` that connect exactly the linked classes of ``signed``, a table of _signatures()."""
    classes = signed.where("n_shingles > 0 and doc_id is not null").groupBy("key_a", "key_b").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("n_shingles").alias("size"))
    rows = scratch.cut(classes.select("rep", "size", F.posexplode("bands").alias("band", "bucket")), "bands")
    # Written before they are joined, so that Spark can split the join's large buckets, which it can't below an aggregate.
    hubs = scratch.cut(rows.groupBy("band", "bucket").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "hubs")
    full = scratch.cut(rows.join(hubs, ["band", "bucket"]), "buckets")
    scratch.drop(rows)
    groups = connected_components(full.select(F.col("rep").alias("a"), F.col("hub").alias("b")), scratch)
    sized = full.groupBy(F.col("rep").alias("id")).agg(F.first("size").alias("size"))
    groups = scratch.cut(groups.join(sized, "id"), "sized")
    totals = scratch.cut(groups.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("elements")), "totals")
    groups = scratch.cut(groups.select("id", "root").join(totals, "root"), "groups")
    fits = (F.col("n") <= BLOCK) & (F.col("elements") <= ELEMENTS)
    small = groups.where(fits & (F.col("n") > 1)).select(F.lit(-1).alias("kind"), F.col("root").alias("task"), F.lit(0).cast("long").alias("pair"), F.lit(0).alias("role"), F.col("id").alias("component"), F.col("id").alias("rep"))
    found = _compared(docs, small, scratch, id_col, text_col, "links")
    large = groups.where(~fits & (F.col("n") > 1)).select("id")
    if large.isEmpty():
        return found
    return found.unionByName(_contracted(docs, scratch.cut(full.join(large, F.col("rep") == F.col("id"), "left_semi"), "large"), scratch, id_col, text_col))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs``."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "near")
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = scratch.cut(text.mapInArrow(_signatures, SIGNED), "signed")
    found = links(docs, signed, scratch, id_col, text_col)
    keyed = signed.where("n_shingles > 0 and doc_id is not null").select("doc_id", "key_a", "key_b")
    reps = scratch.cut(keyed.groupBy("key_a", "key_b").agg(F.min("doc_id").alias("rep")), "reps")
    same = keyed.join(reps, ["key_a", "key_b"]).select("doc_id", "rep")
    components = connected_components(found, scratch)
    member = same.join(components, F.col("rep") == F.col("id"), "left").groupBy("doc_id").agg(F.min(F.coalesce("root", "rep")).alias("component"))
    out = signed.select("doc_id", "n_shingles").join(member, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
