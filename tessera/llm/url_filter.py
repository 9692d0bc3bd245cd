"""URL filters: host and path rules, and a list of canonical URLs behind a blocked Bloom filter.

A blocked Bloom filter of the listed canonical URLs, of bounded size and so broadcast, passes possible hits to an exact hash
join that removes its false positives; URLs that surely are not on the list never leave their partition. The join goes
through skew_safe_lookup(), so one URL may hold any share of the rows.

host: after the first :// up to /, ? or # or the end, A-Z lower-cased; path: from there up to ? or # or the end; both are empty for
a null URL and one without ://. A rule (host, path prefix, verdict) fits its host and all subdomains when the path starts with its
path; the longest fitting rule wins. Without a fitting rule, listed URLs are blocked and all others allowed.

canonical: host without user, www. and the ports 80 and 443; path without slashes at its end; parameters sorted, without
tracking ones; no scheme and fragment; empty for a null URL and one without ://, which are never listed.
All rows stay, repeated ones too. An empty list blocks nothing; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.bloom import BlockedBloom
from tessera.llm.common import ASCII_UPPER, materialize, skew_safe_lookup

#: (host, path prefix, verdict)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Parameters that don't change what a URL shows.
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid)="
#: Host labels of unwanted sites, from which blocklist_of() lists URLs.
UNWANTED = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]


def host_of(url: str | Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), ASCII_UPPER, ASCII_UPPER.lower())


def path_of(url: str | Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: str | Column) -> Column:
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host_of(url), "^[^@]*@", ""), ":(80|443)$", ""), "^www\\.", "")
    query = F.filter(F.split(F.coalesce(F.regexp_extract(url, "://[^?#]*\\?([^#]*)", 1), F.lit("")), "&", -1), lambda p: (p != "") & ~p.rlike(TRACKING))
    tail = F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(query), "&"))).otherwise("")
    return F.when(host == "", "").otherwise(F.concat(host, F.regexp_replace(path_of(url), "/+$", ""), tail))


def rule_name(host: str, path: str) -> str:
    return host + path


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(rule_name(*r[:2])), len(r[0]))):  # the longest ends up outermost
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, rule_name(h, p)).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def listed_urls(pages: DataFrame, labels: list[str] = UNWANTED) -> DataFrame:
    """A list for tests and queries: canonical URLs (canonical, copies) of pages whose host has an unwanted label."""
    at = pages.select(canonical("url").alias("canonical"), host_of("url").alias("host"))
    return at.where(F.arrays_overlap(F.split("host", "\\."), F.array(*map(F.lit, labels)))).groupBy("canonical").agg(F.count("*").alias("copies"))


def judge_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """pages (url, ...) plus host, path, rule, listed and verdict. listed: distinct `canonical`, with `copies`, the rows that
    are expected to have it (any number will do; the largest are broadcast)."""
    listed = materialize(listed.where("canonical <> ''").select("canonical", "copies"), "listed")
    name, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    extra = ["host", "path", "rule", "listed", "verdict"]
    rest = [c for c in pages.columns if c not in extra]
    rows = pages.select(*rest, host_of("url").alias("host"), path_of("url").alias("path"), canonical("url").alias("_canonical"))
    rows = rows.withColumn("rule", name).withColumn("_ruled", verdict)
    tested = BlockedBloom.build(listed, F.xxhash64("canonical")).tested(rows, F.xxhash64("_canonical"), "_possible")
    clear = tested.where("not _possible").drop("_possible").withColumn("listed", F.lit(False))
    named = listed.select(F.col("canonical").alias("_canonical"), "copies", F.lit(True).alias("_hit"))
    found = skew_safe_lookup(tested.where("_possible").drop("_possible"), named, ["_canonical"], ["_hit"], "copies", F.monotonically_increasing_id())
    out = clear.unionByName(found.withColumn("listed", F.coalesce("_hit", F.lit(False))).drop("_hit"))
    return out.select(*rest, "host", "path", "rule", "listed", F.coalesce("_ruled", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))
