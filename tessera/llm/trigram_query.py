"""Boolean trigram queries of regular expressions.

A query is a disjunction of conjunctions: a set of terms, each a set of trigrams,
of which one term's trigrams have to be in every text that the expression matches,
upper case folded to lower. The empty conjunction asks for nothing: such an
expression has no mandatory trigrams.

An expression is followed from left to right with the finite set of strings that
it can have matched so far. Where that set can't be told any more (a repetition
without bound, a wide class, too many strings), the trigrams of the strings are
added to the query and the set starts anew.
"""

from __future__ import annotations

from re import _constants as op
from re import _parser as parser

Term = frozenset[str]
Query = frozenset[Term]

NOTHING: Query = frozenset({frozenset()})
MOST_STRINGS, MOST_CLASS, MOST_TERMS = 64, 8, 64


def grams_of(text: str) -> Term:
    low = text.lower()
    return frozenset(low[i : i + 3] for i in range(len(low) - 2))


def _both(a: Query, b: Query) -> Query:
    """The conjunction; the weaker of the two where it would have too many terms."""
    if len(a) * len(b) > MOST_TERMS:
        return min(a, b, key=lambda q: (q == NOTHING, len(q)))
    return _least(frozenset(x | y for x in a for y in b))


def _least(query: Query) -> Query:
    """Without terms that ask for more than another one."""
    return frozenset(t for t in query if not any(o < t for o in query))


def _of_strings(strings: frozenset[str]) -> Query:
    return _least(frozenset(map(grams_of, strings)))


def _members(node: list) -> frozenset[str] | None:
    """The characters of a class; None if they are many or given by what they are not."""
    found: set[str] = set()
    for kind, value in node:
        if kind is op.LITERAL:
            found.add(chr(value))
        elif kind is op.RANGE and value[1] - value[0] < MOST_CLASS:
            found |= {chr(c) for c in range(value[0], value[1] + 1)}
        else:
            return None
    return frozenset(found) if len(found) <= MOST_CLASS else None


def _walk(items) -> tuple[frozenset[str] | None, Query, bool]:
    """What the items can end with, None for anything; their query without those endings; whether the endings are all that they match."""
    strings: frozenset[str] | None = frozenset({""})
    query, whole = NOTHING, True

    def reset() -> None:
        nonlocal strings, query, whole
        if strings is not None:
            query = _both(query, _of_strings(strings))
        strings, whole = None, False

    def append(options: frozenset[str]) -> None:
        nonlocal strings
        if strings is not None and len(strings) * len(options) > MOST_STRINGS:
            reset()
        strings = options if strings is None else frozenset(a + b for a in strings for b in options)

    for kind, value in items:
        if kind is op.AT:  # a place, no characters
            continue
        if kind is op.LITERAL:
            append(frozenset({chr(value)}))
            continue
        if kind is op.IN and (members := _members(value)):
            append(members)
            continue
        if kind is op.SUBPATTERN:
            parts = [_walk(value[-1])]
        elif kind is op.BRANCH:
            parts = [_walk(b) for b in value[1]]
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            least, most, body = value
            ends, inner, all_of_it = _walk(body)
            if (least, most) == (0, 1) and all_of_it and inner == NOTHING:
                append(ends | {""})
                continue
            if least and all_of_it:  # the first repetition follows what came before
                query = _both(query, inner)
                append(ends)
            elif least:
                query = _both(query, inner if ends is None else _both(inner, _of_strings(ends)))
            reset()
            continue
        else:
            reset()
            continue
        if all(p[2] for p in parts) and (len(parts) == 1 or all(p[1] == NOTHING for p in parts)):
            query = _both(query, parts[0][1]) if len(parts) == 1 else query
            append(frozenset().union(*(p[0] for p in parts)))
        else:
            query = _both(query, _least(frozenset().union(*[q if ends is None else _both(q, _of_strings(ends)) for ends, q, _ in parts])))
            reset()
    return strings, query, whole


def trigram_query(pattern: str) -> Query:
    """The query of a regular expression; NOTHING if it has no mandatory trigrams."""
    strings, query, _ = _walk(parser.parse(pattern))
    return query if strings is None else _both(query, _of_strings(strings))
