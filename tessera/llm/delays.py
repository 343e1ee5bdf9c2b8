"""Piecewise functions from a start to a delivery, as flat lists of whole numbers.

A function is a row of pieces (from, kind, value), in order of ``from``; a piece
holds up to the next one's ``from``. The first begins at NEVER, which stands for "no
parent to wait for". The kinds:

CONST: the value, whatever the start.  SHIFT: the start plus the value.  DEAD: no delivery.
"""

from __future__ import annotations

from bisect import bisect_right

NEVER = -(1 << 62)
CONST, SHIFT, DEAD = 0, 1, 2
Pieces = list[int]


def _joined(pieces: list[tuple[int, int, int]]) -> Pieces:
    """Flat, with neighbours that say the same made one."""
    out: Pieces = []
    for low, kind, value in pieces:
        if not out or out[-2] != kind or (out[-1] != value and kind != DEAD):
            out += (low, kind, value)
    return out


def of_item(arrival: int, repaired: int | None, passes: int, offsets: tuple[int, ...]) -> Pieces:
    """The delivery of an item that starts at its parent's delivery, or at its arrival if that is later.

    Attempt a is made ``offsets[a]`` after the start. One before the repair fails, one
    whose bit is not in ``passes`` fails too; repaired None stands for an item that is
    not faulty, which the first attempt delivers.
    """
    if repaired is None:
        return [NEVER, CONST, arrival, arrival + 1, SHIFT, 0]

    def at(start: int) -> tuple[int, int]:
        for a, offset in enumerate(offsets):
            if start + offset >= repaired and passes >> a & 1:
                return SHIFT, offset
        return DEAD, 0

    kind, value = at(arrival)
    pieces = [(NEVER, DEAD, 0) if kind == DEAD else (NEVER, CONST, arrival + value)]
    starts = sorted({arrival + 1} | {s for o in offsets if (s := repaired - o) > arrival})
    return _joined(pieces + [(s, *at(s)) for s in starts])


def value_at(pieces: Pieces, start: int) -> int | None:
    """The delivery for a start; None for no delivery."""
    k = 3 * (bisect_right(pieces[::3], start) - 1)
    kind, value = pieces[k + 1], pieces[k + 2]
    return None if kind == DEAD else value + (start if kind == SHIFT else 0)


def composed(first: Pieces, then: Pieces) -> Pieces:
    """What ``then`` makes of the deliveries of ``first``: a start goes through both; no delivery stays none."""
    cuts, out = then[::3], []
    for k in range(0, len(first), 3):
        low, kind, value = first[k : k + 3]
        high = first[k + 3] if k + 3 < len(first) else None
        if kind == DEAD:
            out.append((low, DEAD, 0))
        elif kind == CONST:
            got = value_at(then, value)
            out.append((low, DEAD, 0) if got is None else (low, CONST, got))
        else:
            j = bisect_right(cuts, low + value) - 1
            while j < len(cuts) and (high is None or cuts[j] - value < high):
                kind, more = then[3 * j + 1], then[3 * j + 2]
                out.append((max(low, cuts[j] - value), kind, value + more if kind == SHIFT else more))
                j += 1
    return _joined(out)
