"""Trains the block labeller on generated pages: ``python -m tessera.llm.block_training``.

Pages vary in their elements, names, order and faults. What the words are does
not tell main text from the rest (both are drawn alike, in several styles), so
the paths, the shapes and the context have to.
"""

from __future__ import annotations

import random
from pathlib import Path

import numpy as np

from .block_labeller import HIDDEN, WEIGHTS, _sigmoid, features, initial, lstm, save, scores
from .html_blocks import blocks

# Names that page authors give to the parts of a page.
SYLLABLES = "an ber ca de en er for ga hei in ka la mo ne on pa que re sch ti un ver wo éa ñe ß ou th".split()
MAIN = ("article", "main", "div.content", "div.post", "div#main", "section.entry", "div.article-body", "div#content", "td.text", "div.post-content", "div[role=main]", "div.story", "section.article")
NAV = ("nav", "div.nav", "ul.menu", "div#navigation", "div[role=navigation]", "div.breadcrumbs", "header.site-header", "div.topbar", "div.menu", "nav.main-nav")
HEADER = ("header", "div#header", "div.header", "div.masthead", "div[role=banner]", "div.logo")
FOOTER = ("footer", "div#footer", "div.footer", "div.copyright", "div[role=contentinfo]", "footer.site-footer")
SIDE = ("aside", "div.sidebar", "div#sidebar", "div.widget", "aside.related", "section.related", "div[role=complementary]", "div.recommended", "div.share", "div.social", "div.tags")
ADVERT = ("div.ad", "div.ads", "div.advert", "div.banner", "div.promo", "div.sponsored", "aside.advertisement", "div#ad-top")
NOTICE = ("div.cookie", "div.cookie-notice", "div.notice", "div#consent", "div.alert", "div.popup", "div.newsletter", "div.subscribe", "div[role=alert]", "section.notice")
FORM = ("form", "form.search", "div.login", "form#subscribe")
COMMENTS = ("section.comments", "div.comments", "div#comments", "ol.comment-list", "div.comment", "section#disqus", "div.replies")


def _tag(spec: str) -> tuple[str, str]:
    for mark, form in ((".", ' class="{}"'), ("#", ' id="{}"')):
        if mark in spec:
            tag, _, value = spec.partition(mark)
            return tag, form.format(value)
    if "[" in spec:
        tag, _, value = spec.partition("[")
        return tag, " " + value.rstrip("]").replace("role=", 'role="') + '"'
    return spec, ""


class Page:
    """A random page; ``html`` and the label of each of its blocks."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.style = self.r.choice(["prose"] * 6 + ["shout", "symbols", "list", "again"])
        self.out: list[str] = []
        self.labels: list[int] = []
        self.faults = self.r.random() < 0.5
        self.plain = self.r.random() < 0.15  # hardly any telling names
        self.build()
        self.html = "".join(self.out)

    def words(self, low: int, high: int) -> str:
        r = self.r
        out = ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high))]
        if self.style == "shout":
            out = [w.upper() + "!!" for w in out]
        elif self.style == "symbols":
            out = [w + r.choice(["***", "###", "&amp;&amp;", "%%%", "$$$"]) for w in out]
        elif self.style == "list":
            out = [w + " |" for w in out]
        elif self.style == "again":
            out = [out[0]] * len(out)
        text = " ".join(out)
        for place in range(r.randint(6, 14), len(text), r.randint(30, 80)):
            text = text[:place] + (", " if r.random() < 0.5 else ". ") + text[place:] if "&" not in text else text
        return text[:1].upper() + text[1:] + ("." if r.random() < 0.8 else "")

    def block(self, tag: str, label: int, low: int, high: int, inner: str = "") -> None:
        r, text = self.r, self.words(low, high)
        if inner == "a":
            text = f'<a href="/{r.randint(1, 99)}">{text}</a>'
        elif r.random() < 0.2:
            text = f"<b>{text}</b>"
        elif label and r.random() < 0.15:
            half = text.find(" ", len(text) // 2)
            text = f'{text[:half]} <a href="/x">{text[half:]}</a>' if half > 0 and "&" not in text else text
        if self.faults and tag == "p" and r.random() < 0.3:
            self.out.append(r.choice([f"<p>{text}", f"<p><b>{text}<br>", f"<P>{text}<br>"]))
        else:
            name = f' class="{r.choice(["text", "lead", "x1", "body"])}"' if r.random() < 0.1 else ""
            self.out.append(f"<{tag}{name}>{text}</{tag}>" + r.choice(["", "\n"]))
        self.labels.append(label)

    def part(self, specs: tuple[str, ...], label: int, kind: str) -> None:
        r = self.r
        tag, attributes = _tag(r.choice(specs))
        if self.plain and r.random() < 0.7:
            tag, attributes = "div", ""
        self.out.append(f"<{tag}{attributes}>")
        if kind == "links":
            if tag in ("ul", "ol"):
                for _ in range(r.randint(2, 9)):
                    self.block("li", label, 1, 3, "a")
            else:
                self.out.append("<ul>")
                for _ in range(r.randint(2, 9)):
                    self.block("li", label, 1, 3, "a")
                self.out.append("</ul>")
        elif kind == "text":
            if r.random() < 0.5:
                self.out.append(("&copy; " if r.random() < 0.3 else "") + self.words(2, 25))
                self.labels.append(label)
            else:
                for _ in range(r.randint(1, 3)):
                    self.block(r.choice(["p", "div", "h4", "p"]), label, 2, 20, r.choice(["", "", "a"]))
        elif kind == "form":
            self.block("label" if r.random() < 0 else "p", label, 1, 4)
            self.out.append('<input type="text" name="q">')
            self.block("button", label, 1, 2)
        elif kind == "comments":
            if r.random() < 0.6:
                self.block("h3", label, 1, 3)
            item = "li" if tag == "ol" else r.choice(["p", "div"])
            for _ in range(r.randint(1, 5)):
                self.block(item, label, 3, 50)
        self.out.append(f"</{tag}>")

    def article(self) -> None:
        r = self.r
        tag, attributes = _tag(r.choice(MAIN))
        if self.plain and r.random() < 0.5:
            tag, attributes = "div", ""
        outer = tag == "td"
        self.out.append(("<table><tr>" if outer else "") + f"<{tag}{attributes}>")
        if r.random() < 0.85:
            self.block(r.choice(["h1", "h1", "h1", "h2"]), 1, 2, 12)
        for _ in range(r.choice([1, 2, 3, 4, 6, 9, 14, 20])):
            u = r.random()
            if u < 0.78:
                self.block("p", 1, *r.choice([(1, 4), (5, 30), (20, 120)]))
            elif u < 0.86:
                self.block(r.choice(["h2", "h3"]), 1, 1, 8)
            elif u < 0.92:
                kind = r.choice(["ul", "ol"])
                self.out.append(f"<{kind}>")
                for _ in range(r.randint(2, 5)):
                    self.block("li", 1, 2, 15)
                self.out.append(f"</{kind}>")
            elif u < 0.95:
                self.block(r.choice(["blockquote", "pre", "figcaption"]), 1, 3, 30)
            elif u < 0.97:
                self.part(ADVERT, 0, "text")
            elif u < 0.985:
                self.part(SIDE, 0, "links")
            else:
                self.out.append(f"<{tag}></{tag}>" if tag == "div" else "<!-- x -->")
        if r.random() < 0.07:
            self.part(COMMENTS, 0, "comments")
        if not (self.faults and r.random() < 0.1):
            self.out.append(f"</{tag}>" + ("</tr></table>" if outer else ""))

    def build(self) -> None:
        r = self.r
        self.out.append(f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title><style>p{{margin:0}}</style><script>var t=\"</p>\";</script></head><body>")
        top = [(HEADER, "text", 0.35), (NAV, "links", 0.85), (ADVERT, "text", 0.5), (NOTICE, "text", 0.3), (FORM, "form", 0.2), (SIDE, "links", 0.25)]
        bottom = [(COMMENTS, "comments", 0.4), (SIDE, "links", 0.3), (SIDE, "text", 0.2), (ADVERT, "text", 0.25), (NOTICE, "text", 0.2), (FORM, "form", 0.2), (NAV, "links", 0.15)]
        r.shuffle(top)
        r.shuffle(bottom)
        for specs, kind, chance in top:
            if r.random() < chance:
                self.part(specs, 0, kind)
        if r.random() < 0.97:
            self.article()
        for specs, kind, chance in bottom:
            if r.random() < chance:
                self.part(specs, 0, kind)
        if r.random() < 0.85:
            self.part(FOOTER, 0, "text")
        self.out.append(r.choice(["</body></html>", ""]))


def corpus(first: int, n: int) -> tuple[list, list[np.ndarray]]:
    """Blocks and labels of generated pages whose blocks the reader finds as they were meant."""
    pages, labels = [], []
    for seed in range(first, first + n):
        page = Page(seed)
        found = blocks(page.html)
        if len(found) == len(page.labels):
            pages.append(found)
            labels.append(np.array(page.labels, np.float64))
    return pages, labels


def gradients(w: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, live: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """The mean loss of the live blocks, and its gradient by back-propagation through time."""
    grads = {k: np.zeros_like(v) for k, v in w.items()}
    traces: dict[str, list] = {"f": [], "b": []}
    states = np.concatenate([lstm(w, d, x, live, traces[d]) for d in "fb"], axis=2)
    p = _sigmoid(states @ w["o"] + w["p"])
    n = live.sum()
    loss = -(np.log(np.where(y > 0, p, 1 - p) + 1e-9) * live).sum() / n
    dz = (p - y) * live / n
    grads["o"] = np.einsum("tn,tnh->h", dz, states)
    grads["p"] = np.array([dz.sum()])
    for s, d in enumerate("fb"):
        up = dz[:, :, None] * w["o"][s * HIDDEN : (s + 1) * HIDDEN]
        dh, dc = np.zeros(up.shape[1:]), np.zeros(up.shape[1:])
        for t, i, f, o, g, c0, h0, squashed, m in reversed(traces[d]):
            dh = dh + up[t]
            mine = dh * m
            do = mine * squashed
            dn = mine * o * (1 - squashed**2) + dc * m
            gate = np.concatenate([dn * g * i * (1 - i), dn * c0 * f * (1 - f), do * o * (1 - o), dn * i * (1 - g**2)], axis=1)
            grads[f"x{d}"] += x[t].T @ gate
            grads[f"h{d}"] += h0.T @ gate
            grads[f"c{d}"] += gate.sum(axis=0)
            dc = np.where(m, dn * f, dc)
            dh = np.where(m, gate @ w[f"h{d}"].T, dh)
    return float(loss), grads


def train(n: int = 3000, turns: int = 14, batch: int = 48, seed: int = 5) -> dict[str, np.ndarray]:
    pages, labels = corpus(0, n)
    rows = [features([p]).astype(np.float64) for p in pages]
    w = initial(seed)
    first, second, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    r = np.random.default_rng(seed)
    for turn in range(turns):
        order = np.array(sorted(range(len(rows)), key=lambda k: (len(rows[k]) + r.integers(0, 6), k)))
        groups = [order[k : k + batch] for k in range(0, len(order), batch)]
        r.shuffle(groups)
        total = 0.0
        for group in groups:
            steps = max(len(rows[k]) for k in group)
            x, y, live = np.zeros((steps, len(group), rows[0].shape[1])), np.zeros((steps, len(group))), np.zeros((steps, len(group)), bool)
            for c, k in enumerate(group):
                x[: len(rows[k]), c], y[: len(rows[k]), c], live[: len(rows[k]), c] = rows[k], labels[k], True
            # Names are dropped at random, so that no one of them decides.
            x[:, :, :160] *= r.random((1, len(group), 160)) > 0.1
            loss, grads = gradients(w, x, y, live)
            total += loss / len(groups)
            step += 1
            rate = 0.004 * (1 - turn / turns)
            for k in w:
                first[k] += 0.1 * (grads[k] - first[k])
                second[k] += 0.01 * (grads[k] ** 2 - second[k])
                w[k] = w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8) - rate * 1e-3 * w[k]
        print(f"turn {turn}: loss {total:.4f}", flush=True)
    return w


def accuracy(w: dict[str, np.ndarray], first: int = 1_000_000, n: int = 400) -> float:
    """The share of blocks labelled right on pages that training has not seen."""
    pages, labels = corpus(first, n)
    w = {k: v.astype(np.float32) for k, v in w.items()}
    found = scores(w, features(pages), np.array([len(p) for p in pages]))
    return float(((found >= 0.5) == (np.concatenate(labels) > 0)).mean())


if __name__ == "__main__":
    weights = train()
    save(weights, Path(__file__).with_name(WEIGHTS))
    print(f"accuracy on unseen pages {accuracy(weights):.4f}")
