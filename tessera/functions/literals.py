"""What a regular expression cannot match without: literals that are cheaper to look for than the expression."""

from __future__ import annotations

import functools
from re import _constants as op
from re import _parser as parser

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST = 3


def _best(found: list[frozenset[str]]) -> frozenset[str] | None:
    """Of sets of which one member has to be there, the one with the longest shortest member; then the smallest."""
    return max(found, key=lambda s: (min(map(len, s)), -len(s), sorted(s)), default=None)


def _required(items) -> list[frozenset[str]]:
    found, run = [], ""
    for kind, value in [*items, (op.ANY, None)]:
        if kind is op.LITERAL:
            run += chr(value)
            continue
        if len(run) >= LEAST:
            found.append(frozenset({run.lower()}))
        run = ""
        if kind is op.SUBPATTERN:
            found += _required(value[-1])
        elif kind is op.BRANCH:
            parts = [_best(_required(b)) for b in value[1]]
            if all(parts):
                found.append(frozenset().union(*parts))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] > 0:
            found += _required(value[2])
    return found


@functools.lru_cache(maxsize=4096)
def required(pattern: str) -> tuple[str, ...]:
    """Lower-case literals one of which every match holds in lower case; empty if there are none of three characters and more."""
    return tuple(sorted(_best(_required(parser.parse(pattern))) or ()))


def may_match(low: Column, pattern: str) -> Column:
    """Whether ``low``, a text in lower case, holds a literal that the pattern needs; true if it needs none."""
    literals = required(pattern)
    if not literals:
        return F.lit(True)
    there = F.contains(low, F.lit(literals[0]))
    for one in literals[1:]:
        there = there | F.contains(low, F.lit(one))
    return there


def matches_any_case(text: Column, low: Column, pattern: str) -> Column:
    """``text.rlike(pattern)``, asked only where ``low``, the text in lower case, holds a literal that the pattern needs."""
    return may_match(low, pattern) & text.rlike(pattern) if required(pattern) else text.rlike(pattern)
