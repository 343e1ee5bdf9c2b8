"""The secret scan against plain regular expressions over every text, and trigram queries against the texts that patterns match."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm.common import Scratch
from tessera.llm.secrets import RULES, Rule, candidates, secret_scan, trigram_index
from tessera.llm.trigram_query import NOTHING, grams_of, trigram_query

from .helpers import documents


def plain(text: str | None, rules=RULES) -> list[tuple[int, int, int]]:
    found = []
    for k, rule in enumerate(rules):
        found += [(m.start(), k, m.end()) for m in re.finditer(rule.pattern, text or "") if len(m.group(rule.group)) >= rule.least]
    return sorted(found)


def texts() -> list[tuple[int | None, str | None]]:
    r = random.Random(5)
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    upper = lambda n: "".join(r.choice("ABCXYZ0189") for _ in range(n))
    bits = [
        "password = hunter22x", "PassWord:'abcdefgh'", "token=short", "token=api_key:abcdefgh12", 'secret": "a/b+c=d.e-f_g"', "apikey==12345678", "api-key=12345678", "AKIA" + upper(16), "AKIA" + upper(11),
        "AKIAAKIA" + upper(12), hexes(32), hexes(31), hexes(40) + "g", "naïve 日本 token : abcdefghi", "ghp_" + upper(36), "xoxb-" + hexes(12), "https://me:pass12@host/x", "http://host:80/@x", "sk_live_" + hexes(20),
        "-----BEGIN RSA PRIVATE KEY-----", "AIza" + upper(35), "eyJ" + hexes(20) + ".eyJ" + hexes(20) + "." + hexes(9), "pass word tok en", "the ordinary passage",
    ]
    out: list[tuple[int | None, str | None]] = [(0, None), (1, ""), (2, " \n"), (None, bits[0]), (None, bits[0]), (3, bits[0] + "\n" + bits[0]), (4, ("word " * 30 + bits[0] + " " + bits[10] + "\n") * 300)]
    for i in range(5, 90):
        out.append((i, r.choice([" ", "\n", ""]).join(r.choice(bits) if r.random() < 0.4 else r.choice(["the", "Élan", "x" * 40, "日本"]) for _ in range(r.randint(0, 25)))))
    return out + [out[20], out[20]]


@pytest.mark.parametrize("rules", [RULES, RULES[:1], (Rule("any", "[0-9]{6,}"),), RULES + tuple(Rule(f"r{k}", f"abc{k:03d}[0-9]+") for k in range(70))])
def test_against_plain(spark, rules):
    rows = texts()
    got = secret_scan(documents(spark, rows, {"row": "x", "rules": "y", "at": "z", "gram": "g"}), rules).collect()
    shown = lambda pairs: sorted(str(p) for p in pairs)
    assert shown((g["doc_id"], [tuple(s) for s in g["found"]]) for g in got) == shown((i, plain(t, rules)) for i, t in rows)


def test_candidates_hold_all_matches_and_few_others(spark):
    rows = [(i, t) for i, t in texts() if i is not None]
    docs = documents(spark, rows)
    kept, postings = trigram_index(docs, RULES, Scratch(spark, "test"))
    chosen = {r["doc_id"]: set(r["rules"]) for r in candidates(postings, RULES).join(kept, "row").select("doc_id", "rules").collect()}
    for i, t in rows:
        needed = {k for _, k, _ in plain(t) if RULES[k].query != NOTHING}
        assert needed <= chosen.get(i, set())
        for k in chosen.get(i, ()):
            assert any(term <= grams_of(t) for term in RULES[k].query)
    assert postings.groupBy("gram", "row").count().where("count > 1").isEmpty()
    assert postings.where(~F.col("gram").rlike("(?s)^...$")).isEmpty()


PATTERNS = [
    "abc", "ab?c", "a(?:bc|de)f", "(?:foo|.)bar", "zz(?:x.*abc)d", "(?:ab|cd.*ef)x", "(abc)+d", "(?:abc){2,3}", "a{3}bcd", "[xy]oo[^a]bar", "(?:one|two)(?:three|fo+ur)", "^abc$", "ab(?:c|d(?:e|f))g", "(?i:KEY)=\\w+", "a*b", "(a|)bcd", "x(?:ab.)?cde",
]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_queries_are_necessary(pattern):
    """What a pattern matches holds the trigrams of a term; texts are grown from the pattern's own letters."""
    r, query = random.Random(7), trigram_query(pattern)
    words = ["abc", "ab", "c", "de", "bc", "def", "foo", "bar", "x", "zz", "d", "cd", "ef", "one", "two", "three", "four", "foour", "key=", "KEY=", "a", "b", "bcd", "cde", "g", "e", "yoo", "xoo", "-", "1"]
    letters = set(pattern.lower())
    words = [w for w in words if set(w.lower()) <= letters] + ["-", "1"]
    met = 0
    for _ in range(30_000):
        text = "".join(r.choice(words) for _ in range(r.randint(1, 4)))
        if m := re.search(pattern, text):
            met += 1
            assert any(term <= grams_of(m.group()) for term in query), (text, query)
    assert met


def test_queries_ask_for_what_they_can():
    assert trigram_query("[0-9a-f]{32,}") == NOTHING
    assert trigram_query("AKIA[A-Z0-9]+") == {frozenset({"aki", "kia"})}
    assert trigram_query("gh[po]_x") == {frozenset({"ghp", "hp_", "p_x"}), frozenset({"gho", "ho_", "o_x"})}


def test_empty_table(spark):
    assert secret_scan(documents(spark, [(1, "x")]).limit(0)).count() == 0
