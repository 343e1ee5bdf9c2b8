"""Words of whole Arrow batches: boundaries and 64-bit hashes, by numpy alone.

A word is a run of bytes other than 0x20 and 0x09-0x0D, which in UTF-8 is the
pattern ``[^\\x20\\x09-\\x0D]+`` over code points. Hashes are polynomials over
random 64-bit byte codes, then mixed; two given words share one with a
probability of about 2**-58.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_CODES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _CODES.copy()
_LOWER[65:91] = _CODES[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15)


@functools.lru_cache(maxsize=4)
def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    h = h + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """Word boundaries of a run of texts.

    data: the bytes; starts, ends: of each word; doc: its text's number;
    first: for each text, the number of its first word (one more entry at the end).
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.bounds = data, bounds
        n = len(bounds) - 1
        inside = ~_SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[bounds] = True
        before = np.empty(len(data), bool)
        if len(data):
            before[0] = False
            before[1:] = inside[:-1]
        self.starts = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.zeros(len(data), bool)
        if len(data):
            after[:-1] = inside[1:]
        self.ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, bounds, "left")
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(n), self.counts)
        self.inside = inside

    def hashes(self, lower: bool = False) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        values, lengths = self._terms(lower)
        return mix(np.add.reduceat(values, self.starts - self.starts[0]) + lengths.astype(np.uint64))

    def prefix_hashes(self, sizes: tuple[int, ...], lower: bool = False) -> list[np.ndarray]:
        """For each size the hashes of the words' first so many bytes; a word that is no longer has its own."""
        if not len(self.starts):
            return [np.zeros(0, np.uint64) for _ in sizes]
        values, lengths = self._terms(lower)
        total = np.append(np.uint64(0), np.cumsum(values))
        begin = self.starts - self.starts[0]
        out = []
        for size in sizes:
            cut = np.minimum(lengths, size)
            out.append(mix(total[begin + cut] - total[begin] + cut.astype(np.uint64)))
        return out

    def _terms(self, lower: bool) -> tuple[np.ndarray, np.ndarray]:
        """What each byte from the first word on adds to its word's sum; the words' lengths."""
        values = (_LOWER if lower else _CODES)[self.data]
        values[~self.inside] = 0
        lengths = self.ends - self.starts
        spans = np.diff(np.append(self.starts, len(self.data)))
        local = np.arange(self.starts[0], len(self.data)) - np.repeat(self.starts, spans)
        power = _powers(1 << max(6, int(lengths.max()).bit_length()))
        local = np.minimum(local, len(power) - 1)
        return values[self.starts[0] :] * power[local], lengths

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def grams(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """The hash of each n consecutive entries; the last n-1 entries have none."""
    m = max(0, len(h) - n + 1)
    out = np.full(m, np.uint64(seed + n), np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[k : k + m]
        out ^= out >> np.uint64(32)
    return mix(out, seed)


def text_column(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column if pa.types.is_large_string(column.type) else column.cast(pa.large_string())


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(from, to, words) for runs of texts of about ``limit`` bytes; a longer text comes alone. Null texts are empty."""
    column = text_column(column)
    if not len(column):
        return
    if column.null_count:
        column = column.fill_null("")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, len(column))
        yield i, j, Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j
