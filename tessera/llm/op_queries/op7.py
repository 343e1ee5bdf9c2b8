"""op7: verdicts of all page urls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..url_filter import DAMPING, RULES, STEPS, THRESHOLD, url_verdicts

NUMBER, NAME = 7, "op7_url_filter"

_FITS = {r.name: f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))" for r in RULES}
_LONGEST = sorted(RULES, key=lambda r: (-len(r.name), r.name))


def _case(value) -> str:
    return "CASE " + " ".join(f"WHEN {_FITS[r.name]} THEN '{value(r)}'" for r in _LONGEST) + " END"


def _split(url: str) -> tuple[str, str]:
    rest = f"CASE WHEN position('://' IN {url}) > 0 THEN substr({url}, position('://' IN {url}) + 3) ELSE '' END"
    host = f"translate(regexp_extract({rest}, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"coalesce({host}, '')", f"coalesce(regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1), '')"


def _steps(name: str, seed: str, start: str, end: str, weight: str) -> str:
    out = [f"{name}0 AS (SELECT host, {1 - DAMPING!r}::DOUBLE * {seed} AS score FROM seeds WHERE {seed} > 0)"]
    for k in range(STEPS):
        out.append(
            f"{name}{k + 1} AS (SELECT host, sum(score) AS score FROM (SELECT {end} AS host, score * {weight} * {DAMPING!r}::DOUBLE AS score"
            f" FROM {name}{k} JOIN edges ON host = {start} UNION ALL SELECT * FROM {name}0) GROUP BY host)"
        )
    return ",\n".join(out)


SQL = f"""
WITH split AS (SELECT page_id, html, {_split("url")[0]} AS host, {_split("url")[1]} AS path FROM pages
), ruled AS (SELECT page_id, html, host, path, {_case(lambda r: r.name)} AS rule, {_case(lambda r: r.verdict)} AS verdict FROM split
), seeds AS (
  SELECT host, avg(CASE WHEN verdict = 'allow' THEN 1.0::DOUBLE ELSE 0 END) AS allowed, avg(CASE WHEN verdict = 'block' THEN 1.0::DOUBLE ELSE 0 END) AS blocked
  FROM ruled WHERE host <> '' GROUP BY host
), named AS (
  SELECT host AS source, regexp_extract_all(html, '(?is)<a\\s[^>]*?href\\s*=\\s*["'']?((?:[a-z][a-z0-9+.-]*:)?//[^\\s"''>]+)', 1) AS absolute,
    regexp_extract(html, '(?is)<base\\s[^>]*?href\\s*=\\s*["'']?((?:[a-z][a-z0-9+.-]*:)?//[^\\s"''>]+)', 1) AS base,
    list_filter(regexp_extract_all(html, '(?is)<a\\s[^>]*?href\\s*=\\s*["'']?([^\\s"''>]+)', 1), lambda x: NOT regexp_matches(x, '(?i)^([a-z][a-z0-9+.-]*:|//|#)')) AS relative FROM ruled
), targets AS (
  SELECT source, CASE WHEN starts_with(url, '//') THEN 'x:' || url ELSE url END AS url
  FROM (SELECT source, unnest(list_concat(absolute, CASE WHEN base <> '' THEN list_transform(relative, lambda x: base) ELSE [] END)) AS url FROM named)
), links AS (SELECT source, {_split("url")[0]} AS target FROM targets
), pairs AS (SELECT source, target, count(*) AS n FROM links WHERE source <> '' AND target <> '' AND source <> target GROUP BY ALL
), edges AS (SELECT source, target, n / sum(n) OVER (PARTITION BY source) AS along, n / sum(n) OVER (PARTITION BY target) AS against FROM pairs
), {_steps("trust", "allowed", "source", "target", "along")}
, {_steps("distrust", "blocked", "target", "source", "against")}
, scored AS (
  SELECT ruled.*, round(coalesce(t.score, 0), 9) AS trust, round(coalesce(d.score, 0), 9) AS distrust
  FROM ruled LEFT JOIN trust{STEPS} t USING (host) LEFT JOIN distrust{STEPS} d USING (host)
)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN distrust >= {THRESHOLD * (1 - DAMPING)!r}::DOUBLE AND distrust > trust THEN 'block' ELSE 'allow' END) AS verdict, trust, distrust
FROM scored
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
