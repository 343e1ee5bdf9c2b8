"""A bidirectional LSTM that labels the blocks of a page as main text or not, in numpy.

Each block is a vector: hashed features of its tag path (elements, and the words
of their class, id and role), hashed words, and a few shapes (length, share of
linked characters, punctuation, place in the page). One LSTM reads the page's
blocks forwards, one backwards, and a logistic unit on both their states gives
the block's label, so what stands anywhere on the page bears on every block.
"""

from __future__ import annotations

import functools
import math
import zlib
from pathlib import Path

import numpy as np

from .html_blocks import Block, Element
from .words import Words

PATH_SIZE, WORD_SIZE, SHAPES = 160, 16, 9
INPUT = PATH_SIZE + WORD_SIZE + SHAPES
HIDDEN = 24
WEIGHTS = "block_labeller.npz"


@functools.lru_cache(maxsize=1 << 16)
def _place(feature: str) -> int:
    return zlib.crc32(feature.encode()) % PATH_SIZE


@functools.lru_cache(maxsize=1 << 14)
def _own_places(tag: str, names: tuple[str, ...]) -> tuple[int, int]:
    """Bits of the places that an element sets for all within it, and for the blocks of its own."""
    within = {_place("tag " + tag), *(_place("name " + n) for n in names)}
    own = {_place("leaf " + tag), *(_place("own " + n) for n in names)}
    return sum(1 << p for p in within), sum(1 << p for p in own)


def _places(element: Element | None, known: dict[int, int]) -> list[int]:
    """The places that a block of ``element`` sets; known: by id, the bits of the elements of this page."""
    chain, e = [], element
    while e is not None and id(e) not in known:
        chain.append(e)
        e = e.parent
    bits = known[id(e)] if e is not None else 0
    for e in reversed(chain):
        bits |= _own_places(e.tag, e.names)[0]
        known[id(e)] = bits
    if element is not None:
        bits = known[id(element)] | _own_places(element.tag, element.names)[1]
    return [p for p in range(PATH_SIZE) if bits >> p & 1]


def features(pages: list[list[Block]]) -> np.ndarray:
    """A row for each block of all pages, in order."""
    found = [b for page in pages for b in page]
    out = np.zeros((len(found), INPUT), np.float32)
    if not found:
        return out
    rows, columns = [], []
    known: dict[int, int] = {}
    places_of: dict[int, list[int]] = {}
    for k, b in enumerate(found):
        if id(b.element) not in places_of:
            places_of[id(b.element)] = _places(b.element, known)
        places = places_of[id(b.element)]
        rows += [k] * len(places)
        columns += places
    out[rows, columns] = 1
    texts = [b.text.encode() for b in found]
    bounds = np.append(0, np.cumsum([len(t) for t in texts]))
    words = Words(np.frombuffer(b"".join(texts), np.uint8), bounds)
    at = words.doc * WORD_SIZE + (words.hashes(lower=True) % np.uint64(WORD_SIZE)).astype(np.int64)
    hashed = np.bincount(at, minlength=len(found) * WORD_SIZE).reshape(len(found), WORD_SIZE)
    count = words.counts
    out[:, PATH_SIZE : PATH_SIZE + WORD_SIZE] = hashed / np.maximum(count, 1)[:, None]
    data = words.data
    per = lambda mask: np.add.reduceat(mask.astype(np.int64), bounds[:-1]) if len(data) else 0
    size = np.diff(bounds)
    place = np.concatenate([np.arange(len(p)) / max(1, len(p)) for p in pages])
    shape = out[:, PATH_SIZE + WORD_SIZE :]
    shape[:, 0] = np.log1p(size) / 8
    shape[:, 1] = np.log1p(count) / 6
    shape[:, 2] = [min(1.0, b.linked / max(1, len(b.text))) for b in found]
    shape[:, 3] = per((data == 46) | (data == 44)) / np.maximum(count, 1)
    shape[:, 4] = data[bounds[1:] - 1] == 46
    shape[:, 5] = per((data >= 48) & (data <= 57)) / np.maximum(size, 1)
    shape[:, 6] = place
    shape[:, 7] = [(b.element.depth if b.element else 0) / 10 for b in found]
    shape[:, 8] = 1
    return out


def initial(seed: int = 5) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    out = {}
    for d in "fb":
        out[f"x{d}"] = r.normal(0, 1 / math.sqrt(24), (INPUT, 4 * HIDDEN))
        out[f"h{d}"] = r.normal(0, 1 / math.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
        out[f"c{d}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
    out["o"] = r.normal(0, 1 / math.sqrt(2 * HIDDEN), 2 * HIDDEN)
    out["p"] = np.zeros(1)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def lstm(w: dict[str, np.ndarray], d: str, x: np.ndarray, live: np.ndarray, trace: list | None = None) -> np.ndarray:
    """States (steps, pages, HIDDEN) for x (steps, pages, INPUT); a page's state stands still where it isn't live."""
    n = x.shape[1]
    h, c = np.zeros((n, HIDDEN), x.dtype), np.zeros((n, HIDDEN), x.dtype)
    out = np.zeros((x.shape[0], n, HIDDEN), x.dtype)
    inner = x @ w[f"x{d}"] + w[f"c{d}"]
    for t in range(x.shape[0]) if d == "f" else range(x.shape[0] - 1, -1, -1):
        z = inner[t] + h @ w[f"h{d}"]
        i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(z[:, 3 * HIDDEN :])
        m = live[t][:, None]
        new = f * c + i * g
        squashed = np.tanh(new)
        if trace is not None:
            trace.append((t, i, f, o, g, c, h, squashed, m))
        c = np.where(m, new, c)
        h = np.where(m, o * squashed, h)
        out[t] = h
    return out


def scores(w: dict[str, np.ndarray], x: np.ndarray, counts: np.ndarray, batch: int = 128) -> np.ndarray:
    """The chance of each block (a row of x) to be main text; counts: blocks of each page, in order."""
    out = np.zeros(len(x), np.float32)
    first = np.cumsum(counts) - counts
    order = np.argsort(counts, kind="stable")
    order = order[counts[order] > 0]
    at = 0
    while at < len(order):
        # Pages of like length together; a very long page comes with few or no others.
        longest = int(counts[order[min(at + batch, len(order)) - 1]])
        take = max(1, min(batch, (1 << 14) // longest))
        pages = order[at : at + take]
        at += take
        steps = int(counts[pages].max())
        t = np.arange(steps)[:, None]
        live = t < counts[pages][None, :]
        rows = np.minimum(first[pages][None, :] + t, len(x) - 1)
        inputs = np.where(live[:, :, None], x[rows], 0)
        z = np.concatenate([lstm(w, d, inputs, live) for d in "fb"], axis=2) @ w["o"] + w["p"]
        out[rows[live]] = _sigmoid(z)[live]
    return out


@functools.lru_cache(maxsize=1)
def trained() -> dict[str, np.ndarray]:
    """The weights that ``block_training`` made, from beside this module, also when it is in an archive."""
    import importlib.resources
    import io

    content = importlib.resources.files(__package__).joinpath(WEIGHTS).read_bytes()
    with np.load(io.BytesIO(content)) as file:
        return {k: file[k].astype(np.float32) for k in file.files}


def save(w: dict[str, np.ndarray], path: str | Path) -> None:
    np.savez_compressed(path, **{k: v.astype(np.float16) for k, v in w.items()})
