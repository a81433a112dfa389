"""URL filters: many pattern rules, few of them tried on each URL.

A rule is a regular expression over host and path with the whole tokens (runs of a-z and 0-9) that every match must contain. It
is indexed by the one of its tokens that fewest URLs have. The tokens of a URL fetch candidate rules from the index, and only
these run their regular expressions. A rule without a whole token is indexed by the empty token, which every URL has.

Domain rules fit a host and all its subdomains if the path starts with the rule's; the longest wins. Where none fits, the
longest fitting pattern decides, in which ``*`` stands for anything and ``^`` for one character that is no letter or digit, or an end;
where nothing fits, ``allow``. Of equally long rules, block wins.

All steps are SQL functions and joins. Verdicts are made once per distinct URL. The index goes to all tasks if the list of rules is
short; a longer one is joined by token.

Defined results: a null URL, or one without ``://``, has an empty host and path and gets the verdict of no rule; every input
row gives one output row; a URL of any length is read whole; an empty table gives an empty result; other columns pass through untouched,
except those with the names of the result's own columns, which are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: Lists of up to so many rules are broadcast.
_BROADCAST_RULES = 20_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    """``expression`` is searched in host and path written together; ``tokens`` are in lower case."""

    name: str
    verdict: str
    expression: str
    tokens: tuple[str, ...]
    is_domain: bool


def domain_rule(verdict: str, host: str, path: str = "/") -> UrlRule:
    """Fits ``host`` and its subdomains where the path starts with ``path``, which begins with a slash."""
    parts = re.split(r"([^a-z0-9]+)", (host + path).lower())
    whole = parts if not parts[-1] or path == "/" else parts[:-1]  # a path may go on within its last token
    tokens = tuple(part for part in whole[::2] if part)
    expression = r"^(?:[^/]*\.)?" + re.escape(host) + re.escape(path)
    return UrlRule(host + path, verdict, expression, tokens, True)


def pattern_rule(verdict: str, pattern: str) -> UrlRule:
    """``*`` and ``^`` as said above; all else stands for itself, capitals as small letters."""
    pattern = pattern.lower()
    translated = {"*": "[\\s\\S]*", "^": "(?:^|$|[^a-z0-9])"}
    expression = "".join(translated.get(c) or re.escape(c) for c in pattern)
    tokens = re.findall(r"(?<![a-z0-9*])[a-z0-9]+(?![a-z0-9*])", pattern)
    inner = [t.group() for t in re.finditer(r"(?<=[^a-z0-9*])[a-z0-9]+(?=[^a-z0-9*])", pattern)]
    return UrlRule(pattern, verdict, "(?i)" + expression, tuple(t for t in tokens if t in inner), False)


#: Decide where no domain rule fits: advertising, tracking and link farms.
PATTERNS = (
    pattern_rule("block", "^ads^"),
    pattern_rule("block", "^adserver^"),
    pattern_rule("block", "^banners^"),
    pattern_rule("block", "^casino^"),
    pattern_rule("block", "^doubleclick^"),
    pattern_rule("block", "^linkfarm^"),
    pattern_rule("block", "^porn^"),
    pattern_rule("block", "^spam^"),
    pattern_rule("block", "^tracker^"),
    pattern_rule("block", "^xxx^"),
    pattern_rule("allow", "/privacy^ads^"),
)


def _lower(column: Column) -> Column:
    return F.translate(column, _UPPER, _LOWER)


def host_of(url: Column) -> Column:
    return F.coalesce(_lower(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def _index(urls: DataFrame, rules: list[UrlRule]) -> DataFrame:
    """(token, name, verdict, expression, is_domain): every rule under the token that fewest URLs have."""
    spark = urls.sparkSession
    rows = [
        (number, rule.name, rule.verdict, rule.expression, rule.is_domain, token)
        for number, rule in enumerate(rules)
        for token in dict.fromkeys(rule.tokens or ("",))
    ]
    listed = spark.createDataFrame(
        rows, "number int, name string, verdict string, expression string, is_domain boolean, token string"
    )
    small = len(rows) <= _BROADCAST_RULES
    tokens = listed.select("token").distinct()
    seen = (
        urls.select(F.explode("_tokens").alias("token"))
        .join(F.broadcast(tokens) if small else tokens, "token", "left_semi")
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("_urls"))
    )
    weighed = listed.join(F.broadcast(seen) if small else seen, "token", "left").fillna(0, ["_urls"])
    rarest = weighed.groupBy("number").agg(F.min(F.struct("_urls", "token"))["token"].alias("token"))
    return listed.join(rarest, ["number", "token"]).drop("number")


def judge_urls(
    pages: DataFrame, rules: list[UrlRule], patterns: tuple[UrlRule, ...] = PATTERNS, url: str = "url"
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (name of the domain rule), ``pattern`` and ``verdict``."""
    every = [*rules, *patterns]
    address = F.col(url)
    # one row per distinct URL; a null one has no tokens and finds nothing
    distinct = pages.select(address.alias("_url")).filter("_url IS NOT NULL").distinct()
    full = F.concat(host_of(F.col("_url")), path_of(F.col("_url")))
    split = distinct.withColumn("_full", full).withColumn(
        "_tokens", F.array_distinct(F.array_append(F.split(_lower(F.col("_full")), "[^a-z0-9]+"), F.lit("")))
    )
    index = _index(split, every)
    tokens = split.select("_url", "_full", F.explode("_tokens").alias("token"))
    candidates = tokens.join(F.broadcast(index) if len(every) <= _BROADCAST_RULES else index, "token")
    fitting = candidates.filter(F.expr("_full RLIKE expression"))
    # domain rules first, then the longest, then block
    rank = F.col("is_domain").cast("long") * (1 << 40) + F.length("name") * 2 + (F.col("verdict") == "block").cast("long")
    best = (
        fitting.select("_url", "name", "verdict", "is_domain", rank.alias("_rank"))
        .groupBy("_url")
        .agg(F.max(F.struct("_rank", "is_domain", "name", "verdict")).alias("_best"))
    )
    joined = pages.join(best, pages[url] == best["_url"], "left")
    found = best["_best"]
    domain = F.coalesce(found["is_domain"], F.lit(False))
    made = {
        "host": host_of(pages[url]),
        "path": path_of(pages[url]),
        "rule": F.when(domain, found["name"]),
        "pattern": F.when(~domain, found["name"]),
        "verdict": F.coalesce(found["verdict"], F.lit("allow")),
    }
    kept = [pages[name] for name in pages.columns if name not in made]
    return joined.select(*kept, *[column.alias(name) for name, column in made.items()])
