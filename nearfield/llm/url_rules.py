"""URL filters on DataFrame functions alone: rules indexed by their rarest literal token.

A site rule is ``host/path``: it fits the host and all its subdomains if the page's path starts with
the rule's path. A pattern rule is a text with ``*`` for any run of characters, searched in host and
path. Every rule becomes one regular expression, filed under the token (a run of a-z and 0-9) that is
rarest among the given URLs; rules without a whole token are tried on every URL. A page's own tokens
fetch the candidates, and only those run. The index is an array literal addressed by the token's
hash, so judging a page is a projection: no join, no shuffle, and no growth with the data. It grows
with the rules, which are a parameter and travel with the plan.

Site rules come first: of those that fit, the longest decides (then the longer host, then the smaller
text). Otherwise the page is blocked if any pattern fits, else it gets the default verdict. Null URLs
and those without ``://`` have an empty host and path. Repeated rows are judged alike. Only the
columns named by the caller are read, so extra columns cannot clash.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TOKEN = "[a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """``text`` is ``host/path`` of a site rule, or a pattern with ``*`` if ``site`` is false."""

    text: str
    verdict: str
    site: bool = True

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    def regex(self) -> str:
        """Matches ``host`` followed by ``path``, where a path is empty or begins with ``/``."""
        if self.site:
            return "(?s)^([^/]*\\.)?" + _quoted(self.text)
        return "(?s)" + ".*".join(map(_quoted, self.text.split("*")))

    def tokens(self) -> list[str]:
        """Literal tokens that are whole tokens of every URL the rule matches.

        A token at the edge of a literal may be part of a longer one in the URL, except at the
        start of a host, which only a dot or the URL's start can precede.
        """
        found = set()
        for literal in [self.text] if self.site else self.text.split("*"):
            for m in re.finditer(_TOKEN, literal.translate(_FOLD)):
                bounded = (m.start() > 0 or self.site) and m.end() < len(literal)
                if bounded:
                    found.add(m[0])
        return sorted(found)


_FOLD = str.maketrans(_UPPER, _LOWER)


def _quoted(text: str) -> str:
    return "".join(c if re.match("[A-Za-z0-9/_-]", c) else "\\x{%x}" % ord(c) for c in text)


def _fold(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty without ``://``."""
    rest = F.regexp_extract(url, "(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    empty = F.lit("")
    return F.coalesce(_fold(host), empty), F.coalesce(path, empty)


def _tokens(host: Column, path: Column) -> Column:
    folded = F.concat(host, _fold(path))
    return F.array_distinct(F.regexp_extract_all(folded, F.lit(f"({_TOKEN})"), F.lit(1)))


def token_counts(urls: DataFrame, column: str, rules: Sequence[Rule]) -> dict[str, int]:
    """In how many rows each token of the rules occurs; as many numbers as the rules have tokens."""
    wanted = sorted({t for rule in rules for t in rule.tokens()})
    if not wanted:
        return {}
    host, path = host_and_path(F.col(column))
    rows = urls.select(F.explode(F.array_intersect(_tokens(host, path), F.lit(wanted))).alias("t"))
    return {r["t"]: r["count"] for r in rows.groupBy("t").count().collect()}


def _entry(rank: int, rule: Rule, token: str | None) -> Column:
    return F.struct(
        F.lit(rank).alias("rank"),
        F.lit(token).cast("string").alias("token"),
        F.lit(rule.regex()).alias("regex"),
        F.lit(rule.text).alias("text"),
        F.lit(rule.verdict).alias("verdict"),
        F.lit(rule.site).alias("site"),
    )


_ENTRY = (
    "array<array<struct<rank:int,token:string,regex:string,text:string,verdict:string,site:boolean>>>"
)


class RuleIndex:
    """Rules filed under one literal token each, in buckets by the token's CRC-32."""

    def __init__(self, rules: Sequence[Rule], counts: dict[str, int]):
        strongest = sorted(
            set(rules), key=lambda r: (not r.site, -len(r.text), -len(r.host), r.text, r.verdict)
        )
        self.size = max(1, 2 * len(strongest))
        self.buckets: list[list[Column]] = [[] for _ in range(self.size)]
        self.always: list[Column] = []
        for rank, rule in enumerate(strongest):
            tokens = rule.tokens()
            if not tokens:
                self.always.append(_entry(rank, rule, None))
                continue
            rarest = min(tokens, key=lambda t: (counts.get(t, 0), -len(t), t))
            self.buckets[zlib.crc32(rarest.encode()) % self.size].append(_entry(rank, rule, rarest))

    def best(self, host: Column, path: Column) -> Column:
        """The strongest rule that fits, or null."""
        table = F.array(*[F.array(*b) for b in self.buckets]).cast(_ENTRY)
        always = F.array(F.array(*self.always)).cast(_ENTRY)[0]
        url = F.concat(host, path)
        slot = lambda t: F.get(table, F.pmod(F.crc32(t.cast("binary")), F.lit(self.size)))
        fetched = F.flatten(
            F.transform(_tokens(host, path), lambda t: F.filter(slot(t), lambda e: e["token"] == t))
        )
        fits = F.filter(F.concat(always, fetched), lambda e: F.regexp_like(url, e["regex"]))
        return F.array_min(fits)


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule],
    id_column: str = "page_id",
    url_column: str = "url",
    default: str = "allow",
) -> DataFrame:
    """One row per page: its id, host, path, deciding site rule, verdict and deciding pattern."""
    host, path = host_and_path(F.col(url_column))
    index = RuleIndex(rules, token_counts(pages, url_column, rules))
    best = pages.select(
        F.col(id_column), host.alias("host"), path.alias("path")
    ).withColumn("best", index.best(F.col("host"), F.col("path")))
    site = F.coalesce(F.col("best.site"), F.lit(False))
    return best.select(
        id_column,
        "host",
        "path",
        F.when(site, F.col("best.text")).alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"),
        F.when(~site, F.col("best.text")).alias("pattern"),
    )
