"""URL filters: longest-suffix host rules first, then a weighted vocabulary.

The vocabulary is matched with one Aho-Corasick automaton over the ASCII
lower-cased url. A term counts only where no letter or digit touches it. One
strict term rejects a url, and so do `soft_limit` distinct soft terms.

A null url has an empty host and path, fits no rule and hits no term, so it is
allowed. Repeated rows are judged one by one; an empty table gives an empty
result; input columns whose names clash with result columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship

# Terms that reject a url by themselves.
STRICT = ("adult", "bets", "betting", "camgirls", "casino", "cialis", "escort", "escorts", "gambling", "hentai", "malware", "nude", "pharma", "phishing", "pills", "porn", "porno", "sex", "spam", "viagra", "warez", "xxx")
# Terms that reject a url only with others of this list.
SOFT = ("ad", "ads", "banner", "bet", "bingo", "bonus", "cheap", "click", "coupon", "crack", "deal", "discount", "download", "farm", "free", "jackpot", "keygen", "loan", "lottery", "poker", "popup", "prize", "promo", "slots", "torrent", "track", "tracker", "win", "winner")

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class HostRule:
    """`host` and its subdomains, where the path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(rules: Sequence[HostRule], host: Column, path: Column, pick) -> Column:
    """pick(rule) of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the longest ends up outermost
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.lit(pick(rule))).otherwise(out)
    return out


def term_counter(strict: Sequence[str], soft: Sequence[str]):
    """A pandas UDF: url -> (distinct strict terms, distinct soft terms)."""
    listed = [(t, 0) for t in strict] + [(t, 1) for t in soft]

    @F.pandas_udf("struct<strict_hits:int,soft_hits:int>")
    def count(urls: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for number, (term, kind) in enumerate(listed):
            automaton.add_word(term, (number, kind, len(term)))
        if listed:
            automaton.make_automaton()
        touches = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")

        def hits(url: str | None) -> tuple[int, int]:
            found: tuple[set[int], set[int]] = (set(), set())
            for end, (number, kind, size) in automaton.iter(url) if url and listed else ():
                before, after = end - size, end + 1
                if (before < 0 or url[before] not in touches) and (after >= len(url) or url[after] not in touches):
                    found[kind].add(number)
            return len(found[0]), len(found[1])

        for batch in urls:
            yield pd.DataFrame([hits(u) for u in batch], columns=["strict_hits", "soft_hits"], dtype="int32")

    return count


def judge_urls(df: DataFrame, rules: Sequence[HostRule], url: str = "url", strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, soft_limit: int = 2) -> DataFrame:
    """df with host, path, rule, strict_hits, soft_hits and verdict (allow or block)."""
    ship(df.sparkSession)
    address = F.col(url)
    host, path = host_of(address), path_of(address)
    hits = term_counter(strict, soft)(ascii_lower(address))
    out = df.withColumns({"host": host, "path": path, "_hits": hits})
    by_terms = F.when((F.col("_hits.strict_hits") >= 1) | (F.col("_hits.soft_hits") >= soft_limit), "block").otherwise("allow")
    h, p = F.col("host"), F.col("path")
    return out.withColumns({
        "rule": longest_rule(rules, h, p, lambda r: r.text),
        "strict_hits": F.col("_hits.strict_hits"),
        "soft_hits": F.col("_hits.soft_hits"),
        "verdict": F.coalesce(longest_rule(rules, h, p, lambda r: r.verdict), by_terms),
    }).drop("_hits")
