"""Arrays as column expressions whose cost follows their length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scan(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """The running results of ``join``, which has to be associative, over an array.

    By doubling: in step k each element takes up the one 2**k places before it. So n
    elements take n log n steps and as many copies of the array as n has binary
    digits, where an aggregate that appends to its result copies it n times.
    """

    def step(have: Column, far: Column) -> Column:
        return F.transform(have, lambda x, i: F.when(i < far, x).otherwise(join(F.get(have, i - far), x)))

    def over(v: Column) -> Column:
        digits = F.when(F.size(v) > 1, F.ceil(F.log2(F.size(v).cast("double"))).cast("int")).otherwise(F.lit(0))
        powers = F.transform(F.array_repeat(F.lit(1), digits), lambda one, k: F.call_function("shiftleft", one, k))
        return F.aggregate(powers, v, step)

    return let(values, over)


def prefix_sums(values: Column) -> Column:
    """For each element the sum up to it, itself included, of an array without nulls."""
    return scan(values, lambda a, b: a + b)


BLOCK = 512


def blocks(text: Column) -> Column:
    """The text as an array of pieces of BLOCK code points, so that a part far inside is reached without counting from the front."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0))


def part(pieces: Column, start: Column, length: Column) -> Column:
    """``length`` code points from ``start`` (from 0) of a text given as ``blocks``; what lies outside the text is left out."""
    low, high = F.greatest(start, F.lit(0)), start + length
    first = F.call_function("div", low, F.lit(BLOCK)).cast("int")
    count = F.call_function("div", F.greatest(high, low) - 1, F.lit(BLOCK)).cast("int") - first + 1
    inside = F.array_join(F.slice(pieces, first + 1, F.greatest(count, F.lit(0))), "")
    return F.when(high > low, F.substring(inside, (low - first * BLOCK + 1).cast("int"), (high - low).cast("int"))).otherwise("")


_NONE = "cast(array() as array<struct<start:int,end:int,lead:int,value:string>>)"


def matches(text: Column, pattern: str, lead: int | None = None, value: int = 0, alone: bool = False, first: Column | None = None) -> Column:
    """array<struct<start, end, lead, value>> of all matches of a pattern, with offsets in code points.

    The text between matches (a split) and the matches themselves give the offsets:
    each ends where the pieces up to it end, which prefix sums tell. ``lead`` names a
    group whose length is reported, that is how far into the match its value begins;
    ``value`` the group that is the value. alone: groups are taken from the matches, for
    patterns that match their matches by themselves in the same way (no looking around);
    this saves a scan of the text for each group. first: asked before the pattern runs.
    """

    def group(whole: Column, k: int) -> Column:
        return F.transform(whole, lambda m: F.regexp_extract(m, pattern, k)) if alone and k else F.regexp_extract_all(text, F.lit(pattern), F.lit(k))

    def of(whole: Column) -> Column:
        sizes = F.transform(whole, F.length)
        before = F.slice(F.transform(F.split(text, pattern, -1), F.length), 1, F.size(whole))
        ends = prefix_sums(F.zip_with(before, sizes, lambda gap, size: gap + size))
        values = whole if value == 0 else group(whole, value)
        leads = F.transform(whole, lambda x: F.lit(0)) if lead is None else F.transform(group(whole, lead), F.length)
        parts = F.arrays_zip(sizes.alias("size"), leads.alias("lead"), values.alias("value"))
        return F.zip_with(parts, ends, lambda p, end: F.struct((end - p["size"]).alias("start"), end.alias("end"), p["lead"].alias("lead"), p["value"].alias("value")))

    none = F.expr(_NONE)
    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda whole: F.when(F.size(whole) > 0, of(whole)).otherwise(none))  # no scan just to know whether there is one
    return found if first is None else F.when(first, found).otherwise(none)
