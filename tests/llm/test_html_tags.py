"""The page reader takes time in proportion to a page, whatever doesn't close in it, and reads hand-made pages as they are meant."""

from __future__ import annotations

import re
import time

import pytest

from tessera.llm import html_blocks as hb

#: The whole grammar in one expression, which may look through the rest of a page from every tag.
WHOLE = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*+)>|<[!?/][^>]*(?:>|\Z)", re.S)


def found(page: str) -> list[tuple[int, int]]:
    out, at, following = [], 0, hb.tags(page)
    while m := following(at):
        out.append(m.span())
        at = m.end()
    return out


@pytest.mark.parametrize("page", [
    "", "<", "a < b", "<p>x</p>", "<p class='a>b'>x</p>", '<a href="x>y" title=\'z\'>l</a>', "<!-- <p> --><b>x</b>", "<!doctype html><p>", "</>x<p>", "< p>x", "<p", "x<!-- open", "<a b=c'd>x</a>", "<?xml x?><p/>", "<p 'a' \"b\">", "</p x='>'>y", "<é>x</é><p>",
])
def test_tags_are_those_of_the_grammar(page):
    assert found(page) == [m.span() for m in WHOLE.finditer(page)]


def test_what_never_closes():
    assert [b.text for b in hb.blocks("<p>one</p><a 'x <p>two</p> three")][:1] == ["one"]
    assert found("<a '>'<b") == [(0, 7)] or found("<a '>'<b") == [(0, 5)]
    assert found("x <a b <c d") == []
    assert "".join(b.text for b in hb.blocks("<p>a</p> 1 <b 2 <c 3")) == "a1 <b 2 <c 3"


@pytest.mark.parametrize("unit", ["<a '", "<a ", '<a "', "<a '>", "<a \"'", "<!", "<!--", "</", "</a '", "<p>", "<b>", "<div>x", "<a '\">", "<textarea>", "<li><b>"])
def test_time_follows_length(unit):
    def seconds(n: int) -> float:
        began = time.perf_counter()
        hb.blocks("<p>start</p>" + unit * n)
        return time.perf_counter() - began

    seconds(100)
    assert seconds(40_000) < 6


PAGES = [
    ("<html><head><title>T</title><style>p{}</style></head><body><h1>A &amp; B</h1><p>one<br>two <b>three</b>\n four<script>x</script></p><ul><li>i<li>j</ul>tail</body>", ["A & B", "one two three four", "i", "j", "tail"]),
    ("<table><tr><td>a<td>b<tr><td>c</table><p>x<p>y", ["a", "b", "c", "x", "y"]),
    ("<div>a<span>b</span>c<div>d</div>e</div>", ["abc", "d", "e"]),
    ("&lt;p&gt; &#233;&#x65e5;&nbsp;x", ["<p> é日 x"]),
    ("<p>a<!-- b -->c</p><!-- <p>d</p>", ["ac"]),
]


@pytest.mark.parametrize(("page", "texts"), PAGES)
def test_blocks_by_hand(page, texts):
    assert [b.text for b in hb.blocks(page)] == texts
