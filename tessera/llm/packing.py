"""Mixture-controlled packing: deficit round-robin over source queues.

All documents become token ids (each with an end id) and are cut freely into
sequences of at most SEQUENCE ids. Every source has a queue of its documents, by
id. The sequences are filled window by window (a window is ``window_sequences``
sequences): in each the queues are served in turn, each with the quantum ``target
share x window`` plus the deficit it carried over, rounded down to whole tokens;
what the rounding leaves is the deficit that the next window gets. So every window
but the last is full and holds each queue's share to within two tokens, and a
document is cut only where its queue's turn or a sequence ends. Only the last
sequence can be short.

* With ``weights`` (source to weight) a queue's share is its weight among those of
  the queues that still have tokens; when one runs dry in a window, the others take
  its room in proportion and go on with their new shares (and deficits of nothing).
  Sources without a weight are one queue, served when all others are dry. A weight
  must be worth at least one token a window.
* Without, shares are the sources' own shares of all tokens, so all queues run dry in
  the last window. A source of less than one token a window has no turn of its own:
  it rides in the queue of the source before it in order.

Between the windows where a queue runs dry, what a queue has been served before
window i is a closed form in whole numbers, ``floor(i T C_j / C) - floor(i T C_(j-1) /
C)``, with T the window's tokens and C_j the running total of the weights. So
deficits carry across windows and partitions
without any task waiting for another: a document needs its place in its queue only,
which is a prefix sum over range partitions (one number for each partition goes
through the driver). The driver plans no more than one step for each queue that runs dry.

Null and empty texts have the end id alone. A null source is a source of its own.
Rows that repeat an id, or have none, are separate documents; ties are broken by
the order in which they were first written. Columns besides the three that are
named are not read. An empty table gives no pieces.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, ship
from .words import Words, slices

SEQUENCE = 2048
WINDOW_SEQUENCES = 64
END_ID = 1
CACHE_UNITS = 2_000_000
SLICE = 4 << 20
_TOKENIZERS: dict[str, tuple] = {}


#: The split of lower-case texts that ``Units`` knows: contractions, letters, single digits, other signs.
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_LETTER, _DIGIT, _SIGN, _WHOLE = 1, 2, 3, 4
_KIND = np.full(256, _SIGN, np.uint8)
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = _LETTER
_KIND[48:58] = _DIGIT


class Units(Words):
    """Runs of letters, single digits and runs of other signs, as PATTERN cuts them.

    Words that hold anything but ASCII and the letters U+00C0 to U+024F, or an
    apostrophe before a letter, or ``<``, are one unit each: their own text decides.
    """

    def __init__(self, words: Words):
        data = words.data
        odd = (data == 60) | (data == 0xC2) | (data >= 0xCA)
        if len(data) > 1:
            a, b = data[:-1], data[1:]
            odd[:-1] |= (a == 39) & (_KIND[b] == _LETTER)
            odd[:-1] |= ((a == 0xC3) & ((b == 0x97) | (b == 0xB7))) | ((a == 0xC4) & (b == 0xB0)) | ((a == 0xC9) & (b > 0x8F))
        kind = np.where(words.inside, _KIND[data], np.uint8(0))
        count = np.append(0, np.cumsum(odd))
        whole = np.flatnonzero(count[words.ends] > count[words.starts])
        if len(whole):
            mark = np.zeros(len(data) + 1, np.int32)
            mark[words.starts[whole]] += 1
            mark[words.ends[whole]] -= 1
            kind[np.cumsum(mark[:-1]) > 0] = _WHOLE
        edge = np.zeros(len(data) + 1, bool)
        edge[words.bounds] = True
        change = np.append(True, (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT))[: len(data)] | edge[:-1]
        self.data, self.bounds, self.inside = data, words.bounds, words.inside
        self.starts = np.flatnonzero(change & words.inside)
        stop = np.append(change[1:] | edge[1:-1], True)[: len(data)]
        self.ends = np.flatnonzero(stop & words.inside) + 1
        self.first = np.searchsorted(self.starts, self.bounds, "left")
        self.counts = np.diff(self.first)


class Encoder:
    """Ids of whole texts.

    For tokenizers that lower-case texts and cut them by PATTERN, from a cache of
    units; the cache only saves time, and is emptied when it is full. For others,
    text by text.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        known = json.loads(definition)
        normalizers = [n["type"] for n in (known.get("normalizer") or {}).get("normalizers", [])]
        splits = [p["pattern"].get("Regex") for p in (known.get("pre_tokenizer") or {}).get("pretokenizers", []) if p["type"] == "Split"]
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.special and not (t.normalized or t.lstrip or t.rstrip)]
        self.by_unit = normalizers == ["NFC", "Replace", "Lowercase"] and splits == [PATTERN] and bool(special) and all("<" in t for t in special)
        self.mark = special[0] if special else ""
        self.mark_id = self.tokenizer.token_to_id(self.mark)
        self._forget()

    def _forget(self) -> None:
        """The cache: hashes of units in order, and where each one's ids are in one array of ids."""
        self.known, self.begin, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(1, self.dtype)

    def _learn(self, hashes: np.ndarray, units: list[bytes]) -> None:
        for k in range(0, len(units), 4096):
            found = self._units(units[k : k + 4096])
            size = np.array([len(f) for f in found], np.int64) // self.flat.itemsize
            begin = np.cumsum(size) - size + len(self.flat)
            self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(found), self.dtype)])
            self.known, self.begin, self.size = np.append(self.known, hashes[k : k + 4096]), np.append(self.begin, begin), np.append(self.size, size)
        order = np.argsort(self.known, kind="stable")
        self.known, self.begin, self.size = self.known[order], self.begin[order], self.size[order]

    def _units(self, units: list[bytes]) -> list[bytes]:
        """Ids of each unit; one call encodes many, with a special token between them."""
        out: list[bytes] = [b""] * len(units)
        texts = [u.decode() for u in units]
        joined = [k for k, t in enumerate(texts) if "<" not in t]
        if joined:
            ids = np.array(self.tokenizer.encode(f" {self.mark} ".join(texts[k] for k in joined), add_special_tokens=False).ids, np.int64)
            cuts = [*np.flatnonzero(ids == self.mark_id).tolist(), len(ids)]
            ids, begin = ids.astype(self.dtype), 0
            for k, end in zip(joined, cuts, strict=True):
                out[k] = ids[begin:end].tobytes()
                begin = end + 1
        rest = [k for k, t in enumerate(texts) if "<" in t]
        for k, e in zip(rest, self.tokenizer.encode_batch([texts[k] for k in rest], add_special_tokens=False), strict=True):
            out[k] = np.array(e.ids, self.dtype).tobytes()
        return out

    def encode(self, words: Words, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin (one more entry at the end)."""
        if not self.by_unit:
            texts = [words.data[a:b].tobytes().decode() for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True)]
            each = [[*e.ids, end_id] for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
            return np.concatenate([np.array(e, self.dtype) for e in each]), np.append(0, np.cumsum([len(e) for e in each]))
        units = Units(words)
        value, where, inverse = np.unique(units.hashes(lower=True), return_index=True, return_inverse=True)
        if len(self.known) > CACHE_UNITS:
            self._forget()
        at = np.searchsorted(self.known, value)
        new = np.flatnonzero(self.known[np.minimum(at, len(self.known) - 1)] != value) if len(self.known) else np.arange(len(value))
        if len(new):
            data = units.data.tobytes()
            self._learn(value[new], [data[a:b].lower() for a, b in zip(units.starts[where[new]].tolist(), units.ends[where[new]].tolist(), strict=True)])
            at = np.searchsorted(self.known, value)
        # The end id is one unit more, behind each text.
        begin, size = np.append(self.begin[at], 0), np.append(self.size[at], 1)
        order = np.insert(inverse, units.first[1:], len(value))
        each = size[order]
        total = np.append(0, np.cumsum(each))
        ids = self.flat[np.arange(total[-1]) - np.repeat(total[:-1] - begin[order], each)]
        ends = total[np.append(0, units.first[1:] + np.arange(1, len(units.first)))]
        ids[ends[1:] - 1] = end_id
        return ids, ends


def _encoder(definition: str) -> Encoder:
    """One for each worker process."""
    key = hashlib.sha1(definition.encode()).hexdigest()
    if key not in _TOKENIZERS:
        _TOKENIZERS.clear()
        _TOKENIZERS[key] = Encoder(definition)
    return _TOKENIZERS[key]


def _encoded(shared, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            for i, j, words in slices(batch.column(2), SLICE):
                ids, at = encoder.encode(words, end_id)
                content = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer((at * ids.itemsize).astype(np.int64).tobytes()), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(np.diff(at)), content.cast(pa.binary())], ["doc_id", "source", "n", "ids"])

    return run


class Shares:
    """The round-robin of queues whose weights are their own tokens: all run dry in the last window.

    bounds: the running total of the queues' tokens, from 0 to that of all.
    """

    def __init__(self, bounds: list[int], window: int):
        self.bounds, self.total, self.window = bounds, bounds[-1], window

    def before(self, queue: int, w: int) -> tuple[int, int]:
        """Tokens served before window w: of the earlier queues, of this one."""
        served = min(w * self.window, self.total)
        low = served * self.bounds[queue] // self.total
        return low, served * self.bounds[queue + 1] // self.total - low

    def cuts(self, queue: int, x: int, n: int) -> Iterator[tuple[int, int, int]]:
        """(from, length, place in the stream of all windows) of the queue's tokens x to x + n."""
        end = x + n
        w = x * self.total // ((self.bounds[queue + 1] - self.bounds[queue]) * self.window)
        low, mine = self.before(queue, w)
        while mine > x:
            w -= 1
            low, mine = self.before(queue, w)
        low_next, next_ = self.before(queue, w + 1)
        while x < end:
            while next_ <= x:
                w, low, mine = w + 1, low_next, next_
                low_next, next_ = self.before(queue, w + 1)
            take = min(end, next_) - x
            yield x, take, w * self.window + (low_next - low) + (x - mine)
            x += take


@dataclass
class Run:
    """Windows in which a queue, with weights low to high of ``whole``, is served from its token ``start`` on."""

    start: int
    first: int
    low: int
    high: int
    whole: int


@dataclass
class Turn:
    """A single window in which a queue is served from its token ``start`` on, at ``offset``."""

    start: int
    first: int
    offset: int


class Mixture:
    """The round-robin of queues with given whole weights; one without a weight is served when the others are dry."""

    def __init__(self, tokens: list[int], weights: list[int], window: int):
        self.bounds, self.window = [0, *itertools.accumulate(tokens)], window
        self.turns: list[list[Run | Turn]] = [[] for _ in tokens]
        if any(0 < w * window < sum(weights) for w in weights):
            raise ValueError("a weight is worth less than one token a window")
        rest, at = list(tokens), 0
        while any(rest):
            live = self._live(rest, weights)
            whole = sum(live.values())
            windows = min((rest[q] - 1) * whole // (window * w) for q, w in live.items())
            low = 0
            if windows:
                for q, w in live.items():
                    self.turns[q].append(Run(tokens[q] - rest[q], at, low, low + w, whole))
                    rest[q] -= windows * window * (low + w) // whole - windows * window * low // whole
                    low += w
                at += windows
                continue
            offset = 0
            for q, taken in self._last(rest, weights).items():
                self.turns[q].append(Turn(tokens[q] - rest[q], at, offset))
                rest[q] -= taken
                offset += taken
            at += 1

    @staticmethod
    def _live(rest: list[int], weights: list[int]) -> dict[int, int]:
        """The queues that are served now, with their weights."""
        some = {q: weights[q] for q, r in enumerate(rest) if r and weights[q]}
        return some or {q: 1 for q, r in enumerate(rest) if r}

    def _last(self, rest: list[int], weights: list[int]) -> dict[int, int]:
        """What each queue gives to a window in which some may run dry."""
        taken: dict[int, int] = {}
        room, left = self.window, list(rest)
        while room and any(left):
            live = self._live(left, weights)
            whole = sum(live.values())
            dry = [q for q, w in live.items() if left[q] * whole <= room * w]
            if not dry:
                low = 0
                for q, w in live.items():
                    taken[q] = taken.get(q, 0) + room * (low + w) // whole - room * low // whole
                    low += w
                break
            for q in dry:
                taken[q] = left[q]
                room -= left[q]
                left[q] = 0
        return {q: n for q, n in sorted(taken.items()) if n}

    def cuts(self, queue: int, x: int, n: int) -> Iterator[tuple[int, int, int]]:
        """(from, length, place in the stream of all windows) of the queue's tokens x to x + n."""
        turns, end, tokens = self.turns[queue], x + n, self.bounds[queue + 1] - self.bounds[queue]
        k = bisect.bisect_right(turns, x, key=lambda t: t.start) - 1
        while x < end:
            turn = turns[k]
            stop = min(end, turns[k + 1].start if k + 1 < len(turns) else tokens)
            if isinstance(turn, Turn):
                yield x, stop - x, turn.first * self.window + turn.offset + x - turn.start
                x, k = stop, k + 1
                continue
            low = lambda i: i * self.window * turn.low // turn.whole  # noqa: B023, E731
            mine = lambda i: i * self.window * turn.high // turn.whole - low(i)  # noqa: B023, E731
            i = (x - turn.start) * turn.whole // (self.window * (turn.high - turn.low))
            while i and mine(i) > x - turn.start:
                i -= 1
            while x < stop:
                while mine(i + 1) <= x - turn.start:
                    i += 1
                take = min(stop, turn.start + mine(i + 1)) - x
                yield x, take, (turn.first + i) * self.window + low(i + 1) - low(i) + x - turn.start - mine(i)
                x += take
            k += 1


PIECES = "doc_id long, source string, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def _pieces(shared, sequence: int, itemsize: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (doc_id, source, n, ids, place among the tokens of all queues)."""
        names = ["doc_id", "source", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
        kinds = [pa.int64(), pa.string()] + [pa.int64()] * 5 + [pa.binary()]
        rows: list[tuple] = []
        held, schedule = 0, shared.value

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in (0, 1, 2, 4)]
            for k, (doc, source, n, at) in enumerate(zip(*columns, strict=True)):
                ids = np.frombuffer(batch.column(3)[k].as_buffer(), np.uint16 if itemsize == 2 else np.uint32).astype("<u4").tobytes()
                queue = bisect.bisect_right(schedule.bounds, at) - 1
                begin = at - schedule.bounds[queue]
                for x, take, place in schedule.cuts(queue, begin, n):
                    while take:
                        part = min(take, sequence - place % sequence)
                        start = x - begin
                        rows.append((doc, source, start, part, n, place // sequence, place % sequence, ids[4 * start : 4 * (start + part)]))
                        x, place, take = x + part, place + part, take - part
                held += n
                if held > 1 << 20:
                    yield out()
                    rows, held = [], 0
        if rows:
            yield out()

    return run


def pack(
    docs: DataFrame, tokenizer: str, end_id: int = END_ID, sequence: int = SEQUENCE, window_sequences: int = WINDOW_SEQUENCES, weights: dict[str, float] | None = None,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """A row for each piece: ``doc_id, source, start, length, doc_tokens, sequence_id, offset, ids``.

    tokenizer: path of a ``tokenizers`` file that the driver can read. weights: target
    shares of sources, in any unit. ids: little-endian unsigned 32-bit.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "packing")
    with open(tokenizer, encoding="utf-8") as file:
        definition = file.read()
    itemsize, window = _encoder(definition).dtype().itemsize, sequence * window_sequences
    if weights is not None and any(w <= 0 for w in weights.values()):
        raise ValueError("weights are above zero")
    shared = spark.sparkContext.broadcast(definition)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    rows = rows.mapInArrow(_encoded(shared, end_id), "doc_id long, source string, n long, ids binary")
    rows = scratch.cut(rows.withColumn("row", F.monotonically_increasing_id()), "ids")
    # Places in the queues: sums within range partitions, and before each the sum of those that come earlier.
    queue = F.col("source")
    if weights is not None:
        number = F.lit(len(weights))
        for k, name in enumerate(weights):
            number = F.when(F.col("source").eqNullSafe(F.lit(name)), k).otherwise(number)
        queue = number
    slim = rows.select("row", queue.alias("queue"), "doc_id", "n")
    slim = slim.repartitionByRange("queue", "doc_id", "row").withColumn("part", F.spark_partition_id())
    slim = scratch.cut(slim, "places")
    sums = {r["part"]: r["n"] for r in slim.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    total = sum(sums.values())
    if not total:
        return spark.createDataFrame([], PIECES)
    earlier, run = [], 0
    for part in sorted(sums):
        earlier.append((part, run))
        run += sums[part]
    earlier = spark.createDataFrame(earlier, "part int, earlier long")
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("queue", "doc_id", "row")) - F.col("n")
    placed = scratch.cut(slim.withColumn("inside", inside).join(F.broadcast(earlier), "part").select("row", "queue", "n", (F.col("inside") + F.col("earlier")).alias("place")), "placed")
    queues = placed.groupBy("queue").agg(F.min("place").alias("base"), F.sum("n").alias("tokens"))
    if weights is None:
        # Each of these has a token in every window, so there are at most ``window`` of them.
        bases = sorted(r["base"] for r in queues.where(F.col("tokens") * window >= total).select("base").collect())
        schedule = Shares([0, *bases[1:], total] if bases else [0, total], window)
    else:
        tokens = {r["queue"]: r["tokens"] for r in queues.collect()}
        whole = [round(w / max(weights.values()) * 10**9) for w in weights.values()]
        schedule = Mixture([tokens.get(k, 0) for k in range(len(weights) + 1)], [*whole, 0], window)
    # By merging at every size: the places of a large table can't go to every executor.
    full = rows.join(placed.select("row", "place").hint("merge"), "row").select("doc_id", "source", "n", "ids", "place")
    return full.mapInArrow(_pieces(spark.sparkContext.broadcast(schedule), sequence, itemsize), PIECES)
