"""Operator 5, URL filters: pattern rules indexed by their rarest literal token.

Every rule is a regular expression together with the literal tokens that any matching url must contain as
whole tokens. The index holds each rule once, under the token that fewest urls have; the tokens of a url
fetch its candidate rules and only those run their regular expression. All of it is joins, grouping and
built-in functions; there is no Python on the executors.
"""
from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules up to this number are broadcast (a rule takes well under 1 kB); a longer list is joined by shuffle.
BROADCAST_RULES = 20_000

_RULE_SCHEMA = "rule_no int, rule string, tier int, size int, pattern string, verdict string, tokens array<string>"


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched against host + path. ``tokens``: ASCII alphanumeric runs that every matching
    host + path has as whole tokens; none means that the rule is a candidate for every url. Of the rules that
    match, the lowest ``tier`` wins, then the longest ``name``, then the earlier rule."""

    name: str
    pattern: str
    verdict: str
    tokens: tuple[str, ...]
    tier: int = 0


def host_rule(verdict: str, host: str, path: str, tier: int = 0) -> Rule:
    """A rule for ``host`` and its subdomains and all paths that start with ``path`` (which begins with '/')."""
    literal = host + path
    tokens = re.findall("[A-Za-z0-9]+", literal)
    if re.search("[A-Za-z0-9]$", literal):  # the url's token may go on after the prefix
        tokens.pop()
    return Rule(literal, r"^(?:[^/]*\.)?" + re.escape(literal), verdict, tuple(tokens), tier)


def host_label_rule(verdict: str, label: str, tier: int = 1) -> Rule:
    """A rule for every host that has ``label`` between dots."""
    return Rule(label, rf"^(?:[^/]*\.)?{re.escape(label)}(?:\.[^/]*)?(?:/|$)", verdict,
                tuple(re.findall("[A-Za-z0-9]+", label)), tier)


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): the host lies between the first '://' and the next '/', '?', '#' or the end, A-Z in lower
    case; the path goes on from there to '?', '#' or the end. A null, or a url without '://', has both empty."""
    host = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _tokens(address: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(address, F.lit("[A-Za-z0-9]+"), F.lit(0)))


def _index(rules: DataFrame, addresses: DataFrame) -> DataFrame:
    """Each rule with the one of its tokens that the fewest distinct addresses have, '' if it has no token."""
    named = rules.select("rule_no", F.explode("tokens").alias("token"))
    seen = (addresses.select(F.explode(_tokens(F.col("address"))).alias("token"))
            .join(F.broadcast(named.select("token").distinct()) if _few(rules) else named.select("token").distinct(),
                  "token", "left_semi")
            .groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    rarest = (named.join(seen, "token", "left")
              .groupBy("rule_no")
              .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("best")))
    return (rules.join(rarest, "rule_no", "left")
            .select("rule_no", "rule", "tier", "size", "pattern", "verdict",
                    F.coalesce("best.token", F.lit("")).alias("token")))


def _few(rules: DataFrame) -> bool:
    return rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES


def match_rules(addresses: DataFrame, rules: list[Rule]) -> DataFrame:
    """``addresses``: distinct strings host + path in column ``address``. Returns address, rule, tier, verdict of
    the winning rule, for the addresses that some rule matches."""
    spark = addresses.sparkSession
    table = spark.createDataFrame([(i, r.name, r.tier, len(r.name), r.pattern, r.verdict, list(r.tokens))
                                   for i, r in enumerate(rules)], _RULE_SCHEMA)
    index = _index(table, addresses)
    # '' fetches the rules that have no literal token
    fetched = addresses.select("address", F.explode(F.concat(_tokens(F.col("address")), F.array(F.lit(""))))
                               .alias("token"))
    candidates = fetched.join(F.broadcast(index) if _few(table) else index, "token")
    hits = candidates.where(F.expr("regexp_like(address, pattern)"))
    order = F.struct(F.col("tier"), (-F.col("size")).alias("shorter"), "rule_no", "rule", "verdict")
    return (hits.groupBy("address").agg(F.min(order).alias("best"))
            .select("address", "best.rule", "best.tier", "best.verdict"))


def filter_urls(pages: DataFrame, rules: list[Rule], default: str = "allow", key: str = "page_id",
                url: str = "url") -> DataFrame:
    """One row per row of ``pages``: key, host, path, rule, tier, verdict.

    rule and tier are null and the verdict is ``default`` where no rule matches. A null url, an empty one and
    one without '://' have an empty host and path, which only a rule for the empty address can match. Repeated
    rows stay repeated; a null key is kept. Other columns of ``pages`` are not read. The rules run once per
    distinct address, so a hot url costs no more than a rare one; the verdicts are joined back by address.
    """
    host, path = split_url(F.col("url"))
    rows = (pages.select(F.col(key).alias("key"), F.col(url).alias("url"))
            .select("key", host.alias("host"), path.alias("path"))
            .withColumn("address", F.concat("host", "path")))
    best = match_rules(rows.select("address").distinct(), rules)
    return (rows.join(best, "address", "left")
            .select(F.col("key").alias(key), "host", "path", "rule", "tier",
                    F.coalesce("verdict", F.lit(default)).alias("verdict")))
