"""Lower-case alphanumeric tokens of whole texts, with their places."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .words import Words, slices

_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = _ALNUM[128:] = True


class AlnumTokens(Words):
    """Runs of ASCII letters, digits and bytes of other characters; all else separates."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        super().__init__(np.where(_ALNUM[data], data, np.uint8(32)), bounds)
        self.source = data

    def span(self, doc: int, first: int, last: int) -> tuple[int, int, str]:
        """(start, end, text) in code points of text ``doc`` for its tokens first to last, counted from all tokens."""
        base = int(self.bounds[doc])
        a, b = int(self.starts[first]), int(self.ends[last])
        quote = self.source[a:b].tobytes().decode("utf-8", "replace")
        start = len(self.source[base:a].tobytes().decode("utf-8", "replace"))
        return start, start + len(quote), quote


def alnum_slices(column: pa.Array) -> Iterator[tuple[int, int, AlnumTokens]]:
    for i, j, words in slices(column):
        yield i, j, AlnumTokens(words.data, words.bounds)


def alnum_hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return AlnumTokens(data, np.array([0, len(data)])).hashes(lower=True)
