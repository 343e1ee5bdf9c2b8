"""The leaf blocks of an HTML page, in order, with their tag paths.

A small tolerant reader for pages as they come: unclosed and crossed elements,
stray ends, unquoted attributes, comments and raw text. A block is the text
between two block-level boundaries; inline elements and ``br`` don't end one.
Scripts, styles and titles have no blocks; all other text is some block's, so that
the labeller judges it. Elements know the one around them, so a page takes memory
in proportion to its length however deeply it nests.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

# Element names by what they do.
RAW = frozenset("script style title textarea iframe".split())
KEPT_RAW = frozenset(["textarea", "iframe"])
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math object q s samp small span strike strong sub sup svg time tt u var wbr".split())
CLOSES = {
    "p": frozenset(["p"]), "li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]),
    "tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]),
    "option": frozenset(["option"]),
}
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())
SCOPES = frozenset("table ul ol dl select body html div section article main aside td th".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_OTHER = re.compile(r"<!--.*?(?:-->|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME = re.compile(r"[A-Za-z]+")


def tags(page: str) -> Callable[[int], re.Match | None]:
    """A function that finds the next tag, comment or declaration from a place on; its places don't go back.

    A tag whose quotes hide every later ``>`` ends at the next one instead, and from there
    on quotes no longer hide anything; without a later ``>`` what looks like a tag is
    text. So the rest of a page is looked through in vain once, not from each ``<``.
    """
    quotes, last = True, page.rfind(">")

    def following(at: int) -> re.Match | None:
        nonlocal quotes
        while (at := page.find("<", at)) >= 0:
            name = page[at + 1 : at + 2]
            if name == "/":
                name = page[at + 2 : at + 3]
            if name.isascii() and name.isalpha():
                if at < last:
                    m = _TAG.match(page, at) if quotes else None
                    if m is None and (m := _PLAIN_TAG.match(page, at)):
                        quotes = False
                    if m:
                        return m
                if page[at + 1] != "/":
                    at += 1
                    continue
            if m := _OTHER.match(page, at):
                return m
            at += 1
        return None

    return following


@dataclass(frozen=True, eq=False)
class Element:
    """An open block element: its tag, the words of its class, id and role, the block element around it, and how many there are with it."""

    tag: str
    names: tuple[str, ...]
    parent: Element | None
    depth: int


def child(parent: Element | None, tag: str, names: tuple[str, ...]) -> Element:
    return Element(tag, names, parent, parent.depth + 1 if parent else 1)


@dataclass
class Block:
    """text: decoded, white space as single spaces; element: the innermost block element around it; linked: characters within links."""

    text: str
    element: Element | None
    linked: int


def names_of(attributes: str) -> tuple[str, ...]:
    """The words in the class, id and role attributes."""
    if "=" not in attributes:
        return ()
    out = []
    for m in _ATTRIBUTE.finditer(attributes):
        value = next(v for v in m.groups()[1:] if v is not None)
        out += [w.lower() for w in _NAME.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value))]
    return tuple(dict.fromkeys(out))


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    # Name, whether it is a block element, and the block element around it.
    stack: list[tuple[str, bool, Element | None]] = []
    opened: Counter = Counter()
    here: Element | None = None
    held: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                out.append(Block(text, here, linked))
            held.clear()
        linked = 0

    def close(names: frozenset, until: frozenset) -> None:
        """End the innermost open element of ``names`` and what is within, not looking beyond ``until``."""
        nonlocal here
        if not any(opened[n] for n in names):
            return
        for k in range(len(stack) - 1, -1, -1):
            name = stack[k][0]
            if name in names:
                if any(block for _, block, _ in stack[k:]):
                    flush()
                opened.subtract(n for n, _, _ in stack[k:])
                here = stack[k][2]
                del stack[k:]
                return
            if name in until:
                return

    def push(name: str, block: bool, names: tuple[str, ...] = ()) -> None:
        nonlocal here
        stack.append((name, block, here))
        opened[name] += 1
        if block:
            here = child(here, name, names)

    at, following = 0, tags(page)
    while True:
        m = following(at)
        text = page[at : m.start() if m else len(page)]
        if text:
            held.append(text)
            if opened["a"]:
                linked += len(text)
        if not m:
            break
        at = m.end()
        if m.re is _OTHER:  # a comment, a declaration or a stray end
            continue
        name = m[2].lower()
        if m[1]:
            if name == "br":
                held.append(" ")
            elif name == "p" and not opened["p"]:
                flush()
            else:
                close(frozenset([name]), frozenset() if name not in INLINE else SCOPES)
            continue
        if name in RAW and not m[3].rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            if name in KEPT_RAW:
                flush()
                inner = " ".join(html.unescape(page[at : end.start() if end else len(page)]).split())
                if inner:
                    out.append(Block(inner, child(here, name, names_of(m[3])), 0))
            at = end.end() if end else len(page)
            continue
        if name in INLINE:
            if name in VOID:
                held.append(" " if name == "br" else "")
            else:
                push(name, False)
            continue
        if name in CLOSES:
            for _ in range(3):
                close(CLOSES[name], SCOPES)
        elif name in CLOSES_P:
            close(CLOSES["p"], SCOPES)
        flush()
        if name in VOID:
            continue
        push(name, True, names_of(m[3]))
    flush()
    return out
