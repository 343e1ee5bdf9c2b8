"""URL rules and host trust: personalised PageRank forward, distrust backward.

A rule (host, path, verdict) fits the urls of its host and all subdomains whose
path starts with its path; the longest fitting rule decides. Other urls have the
verdict of their host. Hosts are nodes, links between pages of different
hosts (absolute ones, those that begin with //, and relative ones under a base
element of another host) are edges (each pair of hosts once, weighted by the share of the source
host's links). Trust starts at hosts with allowed urls and flows along links;
distrust starts at hosts with blocked urls and flows against them, as in
personalised PageRank and its reverse. A seed's weight is the share of its host's
urls that rules allow or block. A host is blocked if its distrust reaches
``threshold`` of what a wholly blocked host starts with, and exceeds its trust.

Everything is DataFrame operations: the links come from regular expressions on
the html in one pass over the pages, which writes what the later steps need; pairs are pre-aggregated where they are read, each step of the
propagation is an equi-join and a partial aggregation over host edges, and the
verdicts come back by an equi-join on the host. A host with a third of all pages
is one row in the graph; pages are never grouped in one task.

A null url, or one without ``://``, has an empty host and path, fits no rule and
is allowed (an empty host is no node). Null html has no links. Rows that repeat,
or have no id, are judged one by one. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

DAMPING = 0.85
STEPS = 8
THRESHOLD = 0.6


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules, as verdict, host and path.
RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; path: from there up to ``? #`` or the end."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def _targets(html: Column) -> Column:
    """What a page's links name with a host: absolute links, those that begin with //, and relative ones where a base element names another host."""
    named = F.regexp_extract_all(html, F.lit(r"(?is)<a\s[^>]*?href\s*=\s*[\"']?((?:[a-z][a-z0-9+.-]*:)?//[^\s\"'>]+)"), F.lit(1))
    base = F.regexp_extract(html, r"(?is)<base\s[^>]*?href\s*=\s*[\"']?((?:[a-z][a-z0-9+.-]*:)?//[^\s\"'>]+)", 1)
    relative = F.regexp_extract_all(html, F.lit(r"(?is)<a\s[^>]*?href\s*=\s*[\"']?(?![a-z][a-z0-9+.-]*:|//|#)([^\s\"'>]+)"), F.lit(1))
    through_base = F.when(base != "", F.transform(relative, lambda _: base)).otherwise(F.array().cast("array<string>"))
    return F.coalesce(F.concat(named, through_base), F.array().cast("array<string>"))


def _flow(edges: DataFrame, seeds: DataFrame, start: str, end: str, weight: str, scratch: Scratch, steps: int, damping: float) -> DataFrame:
    """(host, score) after ``steps`` steps along edges(start, end, weight) from seeds(host, seed)."""
    base = seeds.select("host", (F.lit(1 - damping) * F.col("seed")).alias("base")).where("base > 0")
    score = base.select("host", F.col("base").alias("score"))
    for step in range(steps):
        moved = score.join(edges, F.col("host") == F.col(start)).groupBy(F.col(end).alias("host")).agg(F.sum(F.col("score") * F.col(weight) * F.lit(damping)).alias("score"))
        score = moved.unionByName(base.select("host", F.col("base").alias("score"))).groupBy("host").agg(F.sum("score").alias("score"))
        if step % 4 == 3 and step + 1 < steps:
            score = scratch.cut(score, "flow")
    return score


def url_verdicts(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD, steps: int = STEPS, damping: float = DAMPING) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` for each row of ``pages``."""
    scratch = Scratch(pages.sparkSession, "urls")
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), _targets(F.col(html_col).cast("string")).alias("targets"))
    host, path = host_and_path(F.col("url"))
    base = base.select("page_id", "url", "targets", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    base = scratch.cut(base.select("page_id", "url", "host", "path", rule.alias("rule"), verdict.alias("ruled"), "targets"), "pages")
    share = lambda v: F.sum(F.when(F.col("ruled") == v, 1.0).otherwise(0.0)) / F.count(F.lit(1))
    seeds = scratch.cut(base.where("host <> ''").groupBy("host").agg(share("allow").alias("allowed"), share("block").alias("blocked")), "seeds")
    links = base.where("size(targets) > 0").select(F.col("host").alias("source"), F.explode("targets").alias("url"))
    # A link that begins with // has the page's scheme, whatever it is.
    links = links.select("source", host_and_path(F.when(F.col("url").startswith("//"), F.concat(F.lit("x:"), F.col("url"))).otherwise(F.col("url")))[0].alias("target"))
    links = links.where("source <> '' and target <> '' and source <> target")
    pairs = scratch.cut(links.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n")), "pairs")
    out_ = pairs.groupBy(F.col("source").alias("s")).agg(F.sum("n").alias("out"))
    in_ = pairs.groupBy(F.col("target").alias("t")).agg(F.sum("n").alias("in"))
    edges = pairs.join(out_, F.col("source") == F.col("s")).join(in_, F.col("target") == F.col("t"))
    edges = scratch.cut(edges.select("source", "target", (F.col("n") / F.col("out")).alias("along"), (F.col("n") / F.col("in")).alias("against")), "edges")
    trust = _flow(edges, seeds.select("host", F.col("allowed").alias("seed")), "source", "target", "along", scratch, steps, damping)
    distrust = _flow(edges, seeds.select("host", F.col("blocked").alias("seed")), "target", "source", "against", scratch, steps, damping)
    scores = trust.select("host", F.col("score").alias("trust"), F.lit(0.0).alias("distrust")).unionByName(distrust.select("host", F.lit(0.0).alias("trust"), F.col("score").alias("distrust")))
    # Written, so that Spark can split a hot host in the join; hosts without any score need no row.
    scores = scratch.cut(scores.groupBy(F.col("host").alias("node")).agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")).where("trust > 0 or distrust > 0"), "scores")
    out = base.join(scores, F.col("host") == F.col("node"), "left").withColumn("trust", F.round(F.coalesce("trust", F.lit(0.0)), 9)).withColumn("distrust", F.round(F.coalesce("distrust", F.lit(0.0)), 9))
    bad = (F.col("distrust") >= F.lit(threshold * (1 - damping))) & (F.col("distrust") > F.col("trust"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(bad, "block").otherwise("allow")).alias("verdict"), "trust", "distrust")
