"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression with literal tokens that every matching URL must
hold.  The tokens of all URLs are counted once; each rule is filed under the
token of its own that the fewest URLs hold.  The tokens of a URL fetch the rules
filed under them, and only those rules run their expression on it.  Rules
without a literal token are few by contract and run on every URL.

The rules are a small table by contract (``MOST_RULES``, refused beyond), which
is the proof for broadcasting them; URLs are never shuffled by a token, so a
token that every URL holds does no harm.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_RULES = 20_000
TOKEN = r"[a-z0-9]+"


@dataclass(frozen=True)
class PatternRule:
    """``pattern`` is searched in the lower-cased URL; ``literals`` are tokens that every match holds; block or allow."""

    pattern: str
    literals: tuple[str, ...]
    verdict: str = "block"


@dataclass(frozen=True)
class HostRule:
    """Fits a host and its subdomains where the path begins with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


# What the method itself blocks: hosts and paths of advertising, gambling, adult, drug and link-farm sites.
PATTERN_RULES = (
    PatternRule(r"\bcasino\b", ("casino",)),
    PatternRule(r"\b(free|best|live)[-_.]bets\b", ("bets",)),
    PatternRule(r"\bpoker\b", ("poker",)),
    PatternRule(r"\bcheap[-_.]pills\b", ("cheap", "pills")),
    PatternRule(r"\bviagra\b", ("viagra",)),
    PatternRule(r"\badult[-_.][a-z]+\b", ("adult",)),
    PatternRule(r"\bporn\b", ("porn",)),
    PatternRule(r"\bxxx\b", ("xxx",)),
    PatternRule(r"\bspam[-_.]farm\b", ("spam", "farm")),
    PatternRule(r"\bads[-_.]track", ("ads",)),
    PatternRule(r"://ads\.", ("ads",)),
    PatternRule(r"://ad\.", ("ad",)),
    PatternRule(r"\bdoubleclick\b", ("doubleclick",)),
    PatternRule(r"/ads/", ("ads",)),
    PatternRule(r"\bpayday[-_.]loans?\b", ("payday",)),
)
HOST_RULES = (
    HostRule("net", "/", "block"), HostRule("example.net", "/en/", "allow"), HostRule("example.com", "/de/", "block"),
    HostRule("org", "/fr/", "allow"),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to a slash, question mark, hash sign or the end, A-Z lower-cased; empty without one."""
    return F.translate(
        F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )


def path_of(url: Column) -> Column:
    """What follows the host, up to a question mark, a hash sign or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest fitting host rule and its verdict; NULL where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for each in sorted(rules, key=lambda r: (len(r.text), r.text)):  # a longer one overrides
        fits = ((host == each.host) | host.endswith("." + each.host)) & path.startswith(each.path)
        rule, verdict = F.when(fits, each.text).otherwise(rule), F.when(fits, each.verdict).otherwise(verdict)
    return rule, verdict


def token_index(urls: DataFrame, rules) -> DataFrame:
    """(token, rules): each rule under the rarest of its literals, by the number of URLs in ``tokens`` that hold it."""
    wanted = sorted({token for rule in rules for token in rule.literals})
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules can be broadcast")
    spark = urls.sparkSession
    counted = urls.select(F.explode(F.array_intersect("tokens", F.array(*map(F.lit, wanted)))).alias("token")).groupBy("token").count()
    seen = {row["token"]: row["count"] for row in counted.collect()}  # at most one row per literal of the rules
    filed = []
    for number, rule in enumerate(rules):
        token = min(rule.literals, key=lambda t: (seen.get(t, 0), t)) if rule.literals else ""
        filed.append((token, number, rule.pattern, rule.verdict))
    return spark.createDataFrame(filed, "token string, number int, pattern string, verdict string").groupBy("token").agg(
        F.sort_array(F.collect_list(F.struct("number", "pattern", "verdict"))).alias("rules")
    )


def judge_urls(pages: DataFrame, page_id="page_id", url="url", host_rules=HOST_RULES, rules=PATTERN_RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, pattern): one row per page.

    The longest fitting host rule decides; else a pattern rule that allows, else
    one that blocks, else the URL is allowed.  A missing URL or one without
    ``://`` has an empty host and path; its text is still searched.
    """
    lowered = F.lower(F.coalesce(F.col("url"), F.lit("")))
    read = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url")).select(
        "page_id", "url", F.array_distinct(F.regexp_extract_all(lowered, F.lit(f"({TOKEN})"), 1)).alias("tokens")
    )
    index = F.broadcast(token_index(read, rules).agg(F.map_from_entries(F.collect_list(F.struct("token", "rules"))).alias("index")))
    fetched = F.flatten(F.transform(F.concat(F.col("tokens"), F.array(F.lit(""))), lambda token: F.coalesce(
        F.element_at("index", token), F.array().cast("array<struct<number:int,pattern:string,verdict:string>>")
    )))
    hits = F.filter("fetched", lambda rule: F.rlike(lowered, rule["pattern"]))
    allowing = F.filter("hits", lambda rule: rule["verdict"] == "allow")
    first = F.when(F.size(allowing) > 0, allowing[0]).otherwise(F.get("hits", F.lit(0)))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = host_rule_of(F.col("host"), F.col("path"), host_rules)
    judged = read.join(index).withColumn("fetched", F.array_sort(fetched)).withColumn("hits", hits)  # the index is one row
    judged = judged.select("page_id", host.alias("host"), path.alias("path"), first.alias("first"))
    return judged.select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.col("first.verdict"), F.lit("allow")).alias("verdict"), F.col("first.pattern").alias("pattern"),
    )


def judge_sql(host_rules=HOST_RULES, rules=PATTERN_RULES) -> str:
    """The same by trying every rule on every URL, for an engine that knows ``regexp_matches``."""
    quote = lambda text: "'" + text.replace("'", "''") + "'"
    fits = []
    for each in sorted(host_rules, key=lambda r: (-len(r.text), r.text)):
        suffix = quote("." + each.host)
        fits.append((f"(host = {quote(each.host)} OR ends_with(host, {suffix})) AND starts_with(path, {quote(each.path)})", each))
    case = lambda pick: "CASE " + " ".join(f"WHEN {test} THEN {quote(pick(rule))}" for test, rule in fits) + " END"
    ordered = [rule for rule in rules if rule.verdict == "allow"] + [rule for rule in rules if rule.verdict != "allow"]
    tests = [(f"regexp_matches(low, {quote(rule.pattern)})", rule) for rule in ordered]
    chosen = lambda pick: "CASE " + " ".join(f"WHEN {test} THEN {quote(pick(rule))}" for test, rule in tests) + " END"
    return f"""
    WITH parsed AS (
      SELECT page_id, lower(coalesce(url, '')) AS low,
        translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
      FROM pages)
    SELECT page_id, host, path, {case(lambda r: r.text)} AS rule,
      coalesce({case(lambda r: r.verdict)}, {chosen(lambda r: r.verdict)}, 'allow') AS verdict, {chosen(lambda r: r.pattern)} AS pattern
    FROM parsed"""
