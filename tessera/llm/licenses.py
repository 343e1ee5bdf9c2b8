"""License scans: winnowed fingerprints in an inverted index, then banded alignment.

Texts and templates are lower-case alphanumeric tokens. From every GUARANTEE
tokens in a row, winnowing keeps the least hash of GRAM consecutive tokens, so a
text and a template that share that many tokens share a kept fingerprint. The
templates' fingerprints make an inverted index; it is a fixed table, so it goes
to the executors with the code. Fingerprints that a text shares with a template,
on diagonals no further than BAND from each other, make a candidate. Each is
aligned token by token, within a band of that width around its diagonal; matches
score 1, other steps -1.

A template marks in braces what tells its license from others: names and
versions. An alignment counts only if each of these stretches is matched word for
word, in one piece, with nothing put in; where one ends in a number, the text's
number must end there too ("2" isn't "2.1", "2.0" is), and where it begins with
a word that a hyphen ties to the one before it in the text, it isn't that name.
A word of NEGATIONS that the text puts into a notice, or that stands within two words
before it in the same sentence, takes the report back ("is not licensed under the MIT
License").
Coverage is the matched tokens as a share of the template's tokens and of the
text's tokens in the span that match nothing; it must reach MIN_COVERAGE. Of
overlapping reports the one with more matches stays, of equals the first
template's.

Every text is searched in full, in the task that reads it; nothing is shuffled.
Null and empty texts hold no license. Rows with equal or null ids are searched
one by one. Columns besides the id and the text are not read.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship
from .license_templates import TEMPLATES
from .tokens import AlnumTokens, alnum_hashes, alnum_slices
from .words import grams

GRAM, GUARANTEE = 3, 5
BAND = 8
MIN_COVERAGE = 0.8
# Words that deny what follows.
NEGATIONS = ("not", "never", "isn", "aren", "wasn", "longer")
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_SENTENCE = re.compile(rb"[.;:!?\n]")
_MARK = re.compile(r"[{}]")


def winnow(h: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the kept fingerprints; ends: for each token the end of its text.

    Of each run of GUARANTEE - GRAM + 1 hashes that lie in one text the least is
    kept, the first of equals; a text with fewer hashes keeps them all.
    """
    g = grams(h, GRAM, 91)
    if not len(g):
        return np.zeros(0, np.int64), g
    place = np.arange(len(g))
    inside = place + GRAM <= ends[: len(g)]
    value = np.where(inside, g, _TOP)
    keep = np.zeros(len(g), bool)
    window = GUARANTEE - GRAM + 1
    n = len(g) - window + 1
    if n > 0:
        whole = np.flatnonzero(place[:n] + GUARANTEE <= ends[:n])
        rows = np.stack([value[whole + k] for k in range(window)])
        keep[whole + rows.argmin(axis=0)] = True
    first = np.append(True, ends[1:] != ends[:-1])[: len(g)]
    few = inside & first & (ends[: len(g)] - place < GUARANTEE)
    keep |= few
    kept = np.flatnonzero(keep & inside)
    return kept, g[kept]


def marked_tokens(text: str) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """A template's token hashes, and its marked stretches (first, end)."""
    parts = _MARK.split(text)  # outside, marked, outside, ...
    hashes = [alnum_hashes(p) for p in parts]
    ends = np.cumsum([len(h) for h in hashes]).tolist()
    stretches = [(ends[k - 1], ends[k]) for k in range(1, len(parts), 2)]
    return np.concatenate(hashes), stretches


class TemplateIndex:
    def __init__(self, templates: dict[str, tuple[str, ...]]):
        self.names, self.tokens, self.stretches, found = [], [], [], []
        for name in templates:
            for text in templates[name]:
                h, stretches = marked_tokens(text)
                at, value = winnow(h, np.full(len(h), len(h)))
                found += [(int(v), len(self.names), int(a)) for a, v in zip(at, value, strict=True)]
                self.names.append(name)
                self.tokens.append(h)
                self.stretches.append(stretches)
        found.sort()
        self.value = np.array([f[0] for f in found], np.uint64)
        self.template = np.array([f[1] for f in found], np.int64)
        self.at = np.array([f[2] for f in found], np.int64)
        self.table = np.zeros(1 << 16, bool)
        self.table[self.value & np.uint64(0xFFFF)] = True


def align(template: np.ndarray, text: np.ndarray, shift: int, band: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in the template, places in the text) of the matches of the best local alignment in which text place - template place stays within ``band`` of ``shift``.

    A row of cells a template token, filled by numpy; cell b of row i is the text
    token i + shift - band + b. Scores along a row come from a running maximum.
    """
    width, n, m = 2 * band + 1, len(text), len(template)
    column = np.arange(width)
    place = np.arange(m)[:, None] + (shift - band) + column[None, :]
    inside = (place >= 0) & (place < n)
    hit = inside & (text[np.clip(place, 0, max(n - 1, 0))] == template[:, None]) if n else np.zeros((m, width), bool)
    score = np.zeros((m + 1, width + 1), np.int64)
    for i in range(m):
        cell = np.maximum(score[i, :width] + np.where(hit[i], 1, -1), score[i, 1:] - 1)
        cell = np.where(inside[i], np.maximum(cell, 0), 0)
        score[i + 1, :width] = np.maximum.accumulate(cell + column) - column
        score[i + 1, :width][~inside[i]] = 0
    best = int(np.where(hit, score[1:, :width], 0).argmax()) if m else 0
    i, b = divmod(best, width)
    pairs = []
    while m and i >= 0 and b >= 0 and score[i + 1, b] > 0:
        value = score[i + 1, b]
        if hit[i, b] and value == score[i, b] + 1:
            pairs.append((i, place[i, b]))
            i -= 1
        elif value == score[i, b] - 1:
            i -= 1
        elif value == score[i, b + 1] - 1:
            i, b = i - 1, b + 1
        else:
            b -= 1
    pairs.reverse()
    return np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)


def holds_marks(tokens: AlnumTokens, doc: int, stretches: list[tuple[int, int]], mine: np.ndarray, theirs: np.ndarray) -> bool:
    """Whether each stretch is matched in one piece, as a name or number of its own. theirs: numbers of the text's tokens."""
    to = dict(zip(mine.tolist(), theirs.tolist(), strict=True))
    begin, end = int(tokens.bounds[doc]), int(tokens.bounds[doc + 1])
    for first, stop in stretches:
        if any(k not in to or to[k] != to.get(first, -1) + k - first for k in range(first, stop)):
            return False
        a, b = int(tokens.starts[to[first]]), int(tokens.ends[to[stop - 1]])
        if a > begin and tokens.source[a - 1] == 45:  # a hyphen
            return False
        rest = tokens.source[b : min(b + 4, end)].tobytes()
        if re.match(rb"\.[1-9]|\.0[0-9]|-[A-Za-z0-9]", rest):
            return False
    return True


def denied(tokens: AlnumTokens, h: np.ndarray, doc: int, matched: np.ndarray) -> bool:
    """Whether a denying word lies between the matched tokens (their numbers) or shortly before them in their sentence."""
    first, stop = int(matched[0]), int(matched[-1]) + 1
    inside = np.setdiff1d(np.arange(first, stop), matched)
    if np.isin(h[inside], _denials()).any():
        return True
    low = max(first - 2, int(tokens.first[doc]))
    for k in np.flatnonzero(np.isin(h[low:first], _denials())) + low:
        if not _SENTENCE.search(tokens.source[int(tokens.ends[k]) : int(tokens.starts[first])].tobytes()):
            return True
    return False


@functools.cache
def _denials() -> np.ndarray:
    return np.concatenate([alnum_hashes(w) for w in NEGATIONS])


FOUND = "doc_id long, license string, template long, matched long, template_tokens long, coverage double, start long, end long, passage string"


def report(index: TemplateIndex, tokens: AlnumTokens, h: np.ndarray, doc: int, t: int, shift: int, low: int, high: int, band: int) -> tuple[int, float, int, int] | None:
    """(matched, coverage, first token, end token) of template t among the tokens low to high, or None."""
    mine, theirs = align(index.tokens[t], h[low:high], shift - low, band)
    matched = len(mine)
    if not matched:
        return None
    first, stop = int(theirs[0]) + low, int(theirs[-1]) + low + 1
    coverage = matched / (len(index.tokens[t]) + stop - first - matched)
    if coverage < MIN_COVERAGE or not holds_marks(tokens, doc, index.stretches[t], mine, theirs + low) or denied(tokens, h, doc, theirs + low):
        return None
    return matched, coverage, first, stop


def chosen(index: TemplateIndex, reports: list[tuple[int, float, int, int, int]]) -> list[tuple[int, float, int, int, int]]:
    """Of overlapping reports (matched, coverage, first, end, template) those with more matches; each once."""
    out: list[tuple[int, float, int, int, int]] = []
    for r in sorted(reports, key=lambda r: (-r[0], -r[1], r[4], r[2])):
        if not any(a < r[3] and r[2] < b for _, _, a, b, _ in out):
            out.append(r)
    return out


def _search(index: TemplateIndex, tokens: AlnumTokens) -> Iterator[tuple[int, tuple[int, float, int, int, int]]]:
    """(document, report) of a run of texts."""
    h = tokens.hashes(lower=True)
    if not len(h):
        return
    place, value = winnow(h, tokens.first[tokens.doc + 1])
    maybe = index.table[value & np.uint64(0xFFFF)]
    place, value = place[maybe], value[maybe]
    low, high = np.searchsorted(index.value, value, "left"), np.searchsorted(index.value, value, "right")
    count = high - low
    which = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - low, count)
    place = np.repeat(place, count)
    doc, template = tokens.doc[place], index.template[which]
    diagonal = place - index.at[which]
    order = np.lexsort((diagonal, template, doc))
    at = 0
    reports: dict[int, list[tuple[int, float, int, int, int]]] = {}
    while at < len(order):
        o = order[at]
        d, t, begin = int(doc[o]), int(template[o]), int(diagonal[o])
        end = at + 1
        while end < len(order) and doc[order[end]] == d and template[order[end]] == t and diagonal[order[end]] <= begin + BAND:
            end += 1
        shift = begin + int(diagonal[order[end - 1]] - begin) // 2
        at = end
        size = len(index.tokens[t])
        low_, high_ = max(int(tokens.first[d]), shift - BAND), min(int(tokens.first[d + 1]), shift + size + BAND)
        if (found := report(index, tokens, h, d, t, shift, low_, high_, BAND)) is not None:
            reports.setdefault(d, []).append((*found, t))
    for d in sorted(reports):
        for r in chosen(index, reports[d]):
            yield d, r


def _found(templates: dict[str, tuple[str, ...]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TemplateIndex(templates)
        names = ["doc_id", "license", "template", "matched", "template_tokens", "coverage", "start", "end", "passage"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            out = []
            for i, j, tokens in alnum_slices(batch.column(1)):
                for d, (matched, coverage, first, stop, t) in _search(index, tokens):
                    out.append((batch.column(0)[i + d].as_py(), index.names[t], t, matched, len(index.tokens[t]), coverage, *tokens.span(d, first, stop - 1)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return run


def licenses(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each license notice found in ``docs``: what, how much of its template, and where (code points)."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_found(templates or TEMPLATES), FOUND)
