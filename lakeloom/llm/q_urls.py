"""op9: every page's url judged by four host rules and the url vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .urlfilter import SOFT, STRICT, HostRule, judge_urls

RULES = (HostRule("block", "net", "/"), HostRule("allow", "example.net", "/en/"), HostRule("block", "example.com", "/de/"), HostRule("allow", "org", "/fr/"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


def _hits(terms: tuple[str, ...]) -> str:
    return " + ".join(f"coalesce(regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')::int, 0)" for t in terms)


def _fits(r: HostRule) -> str:
    return f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"


_LONGEST = sorted(RULES, key=lambda r: -len(r.text))
OP9_SQL = f"""
WITH p AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
         translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS u
  FROM pages), h AS (
  SELECT page_id, host, path, {_hits(STRICT)} AS strict_hits, {_hits(SOFT)} AS soft_hits FROM p)
SELECT page_id, host, path,
       CASE {" ".join(f"WHEN {_fits(r)} THEN '{r.text}'" for r in _LONGEST)} END AS rule,
       CASE {" ".join(f"WHEN {_fits(r)} THEN '{r.verdict}'" for r in _LONGEST)}
            WHEN strict_hits >= 1 OR soft_hits >= 2 THEN 'block' ELSE 'allow' END AS verdict
FROM h"""
