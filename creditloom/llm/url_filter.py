"""URL filter: pattern rules indexed by their rarest literal token.

A rule is literal text with three signs: ``||`` at the start stands for a host
or any subdomain of it, ``*`` for any characters, ``^`` for one separator or the
end. Of a rule's literal tokens (runs of a-z and 0-9 with a boundary on both
sides) the one that is rarest among all given URLs is its index key. A URL's
tokens fetch the rules filed under them, and only those run as regular
expressions. Everything is column expressions: the index is a literal array of
buckets, its size bounded by the caller's rules, so no row moves or multiplies
and a hot host or token costs no more than another.

Base rules win over pattern rules; among rules of one kind the longest text
wins, then block over allow. A URL without any matching rule is allowed. A null
URL or one without ``://`` has an empty host and path and matches nothing.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Base rules of the contract.
BASE_RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)

# Pages that are no content of their own.
PATTERN_RULES = (
    ("/wp-admin/", "block"),
    ("/cgi-bin/", "block"),
    ("/login^", "block"),
    ("/signup^", "block"),
    ("/cart^", "block"),
    ("/checkout^", "block"),
    ("/tag/*/page/", "block"),
    ("?replytocom=", "block"),
    ("?sessionid=", "block"),
    ("&sessionid=", "block"),
    ("?page=*&ref=", "block"),
    ("?utm_source=", "block"),
    ("&utm_source=", "block"),
    ("?print=1^", "block"),
    ("/feed/^", "block"),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATOR = r"(?:[^A-Za-z0-9_.%-]|$)"
INDEX_TYPE = "array<array<struct<token:string,regex:string,base:int,size:int,block:int,rule:string>>>"


@dataclass(frozen=True)
class Rule:
    text: str
    action: str
    base: bool

    @property
    def pattern(self) -> str:
        return f"||{self.text}" if self.base else self.text

    @property
    def regex(self) -> str:
        body, head = self.pattern, ""
        if body.startswith("||"):
            body, head = body[2:], r"^(?:[^/?#]*\.)?"
        return head + "".join({"*": r"[\s\S]*", "^": SEPARATOR}.get(c, re.escape(c)) for c in body)

    @property
    def tokens(self) -> list[str]:
        """Tokens that every matching URL holds whole, with A-Z lowered."""
        body = self.pattern
        anchored = body.startswith("||")
        body = body[2:] if anchored else body
        out = []
        for m in re.finditer(r"[A-Za-z0-9]+", body):
            left = m.start() > 0 and body[m.start() - 1] != "*" or m.start() == 0 and anchored
            right = m.end() < len(body) and body[m.end()] != "*"
            if left and right:
                out.append(m[0].translate(str.maketrans(UPPER, LOWER)))
        return out


def lower_ascii(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host with A-Z lowered, path, and the rest from ``?`` or ``#`` on; empty without ``://``."""
    at = F.instr(url, "://")
    after = F.when(F.coalesce(at, F.lit(0)) > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    rest = F.regexp_extract(after, r"^[^?#]*([\s\S]*)", 1)
    return lower_ascii(host), path, rest


def url_tokens(target: Column) -> Column:
    return F.array_distinct(F.split(lower_ascii(target), "[^a-z0-9]+"))


def rarest_tokens(urls: DataFrame, rules: list[Rule]) -> dict[str, str | None]:
    """Index token of every rule, by counts over all URLs; only the rules' own tokens are counted and collected."""
    known = sorted({t for r in rules for t in r.tokens})
    found = urls.select(F.explode(F.array_intersect("tokens", F.array(*map(F.lit, known)))).alias("token")) if known else None
    counts = dict(found.groupBy("token").count().collect()) if known else {}
    return {r.text: min(r.tokens, key=lambda t: (counts.get(t, 0), t), default=None) for r in rules}


def rule_index(rules: list[Rule], token_of: dict[str, str | None]) -> tuple[Column, Column, int]:
    """Buckets of rules by token, the rules without any token, and the number of buckets."""
    buckets = 1 << max(4, (2 * len(rules)).bit_length())
    filed: dict[int, list[Rule]] = {}
    loose = []
    for r in rules:
        token = token_of[r.text]
        (filed.setdefault(_slot(token, buckets), []) if token else loose).append(r)

    def entry(r: Rule) -> Column:
        values = [F.lit(token_of[r.text] or ""), F.lit(r.regex), F.lit(int(r.base)), F.lit(len(r.text)), F.lit(int(r.action == "block")), F.lit(r.text)]
        return F.struct(*(v.alias(n) for v, n in zip(values, ("token", "regex", "base", "size", "block", "rule"), strict=True)))

    one = INDEX_TYPE[len("array<") : -1]
    row = lambda rs: F.array(*map(entry, rs)).cast(one)
    return F.array(*(row(filed.get(k, [])) for k in range(buckets))).cast(INDEX_TYPE), row(loose), buckets


def _slot(token: str, buckets: int) -> int:
    return zlib.crc32(token.encode()) % buckets


def _slot_of(token: Column, buckets: int) -> Column:
    return (F.crc32(token.cast("binary")) % buckets + 1).cast("int")


def judge(pages: DataFrame, base_rules=BASE_RULES, pattern_rules=PATTERN_RULES, url_col: str = "url") -> DataFrame:
    """All columns of ``pages`` in one struct ``page``, with host, path, rule (of the base rules), pattern, verdict.

    ``rule`` is null without a matching base rule, ``pattern`` without a matching pattern rule.
    """
    rules = [Rule(t, a, True) for t, a in base_rules] + [Rule(t, a, False) for t, a in pattern_rules]
    page = F.struct(*(F.col(f"`{c}`") for c in pages.columns))
    host, path, rest = parts(F.col(f"`{url_col}`"))
    split = pages.select(page.alias("page"), host.alias("host"), path.alias("path"), rest.alias("rest"))
    target = F.concat("host", "path", "rest")
    urls = split.select("page", "host", "path", target.alias("target"), url_tokens(target).alias("tokens"))
    index, loose, buckets = rule_index(rules, rarest_tokens(urls, rules))
    fetched = F.flatten(
        F.transform("tokens", lambda t: F.filter(F.element_at(index, _slot_of(t, buckets)), lambda r: r["token"] == t))
    )
    matched = F.filter(F.concat(fetched, loose), lambda r: F.regexp_like(F.col("target"), r["regex"]))
    ranked = F.transform(matched, lambda r: F.struct(r["base"], r["size"], r["block"], r["rule"]))
    best = urls.select("page", "host", "path", ranked.alias("ranked"))
    top = F.array_max("ranked")
    of = lambda base: F.array_max(F.filter("ranked", lambda r: r["base"] == base))["rule"]
    return best.select(
        "page",
        "host",
        "path",
        of(1).alias("rule"),
        of(0).alias("pattern"),
        F.when(top["block"] == 1, "block").otherwise("allow").alias("verdict"),
    )
