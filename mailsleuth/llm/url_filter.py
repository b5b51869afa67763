"""URL filter: rules by host and path first, then a list of canonical URLs behind a blocked Bloom filter.

A URL that no rule fits is blocked if its canonical form is listed. The Bloom filter of the list lets almost
all other URLs through without a join; only possible hits meet the list itself in an exact hash join.

Defined results: a null url, or one without ``://``, has an empty host and path and no canonical form, so it is
allowed; an empty list blocks nothing; repeated rows are judged each; columns of the input other than the id
and the url are not read. Rules are a short literal parameter; the list may have any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import LOWER, UPPER, Bloom

# (verdict, rule): host, then path from its first slash
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
LISTED_LABEL = "spam"


def host(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host, path without closing slashes, and sorted query parameters other than ``utm_``; null without host."""
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: ~p.startswith("utm_") & (p != "")))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(host(url) != "", F.concat(host(url), F.regexp_replace(path(url), "/+$", ""), tail))


def fitting_rule(host_: Column, path_: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """Longest rule that fits, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host_ == name) | host_.endswith("." + name)) & path_.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def listed_urls(pages: DataFrame, label: str = LISTED_LABEL, url: str = "url") -> DataFrame:
    """Canonical URLs of all pages whose host has a label that holds ``label``: the list of this query."""
    seen = pages.select(host(F.col(url)).alias("h"), canonical(F.col(url)).alias("canon"))
    return seen.where(F.col("h").contains(label) & F.col("canon").isNotNull()).select("canon").distinct()


def judge_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str]] = RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """``listed`` has a column ``canon``. Returns id, host, path, rule, verdict, possible_hit, listed."""
    keys = listed.select("canon").where(F.col("canon").isNotNull()).distinct()
    bloom = Bloom(keys.select(F.xxhash64("canon").alias("h")), "h")
    rows = pages.select(F.col(page_id).alias("page_id"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"), canonical(F.col(url)).alias("_canon"))
    rule, ruled = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), ruled.alias("_ruled"), bloom.may_hold(F.xxhash64("_canon")).alias("_hit"))
    rows = rows.withColumn("possible_hit", F.col("_hit") & F.col("_canon").isNotNull()).drop("_hit")
    hits = rows.where("possible_hit").join(keys.select(F.col("canon").alias("_canon"), F.lit(True).alias("listed")).hint("shuffle_hash"), "_canon", "left")
    misses = rows.where("not possible_hit").withColumn("listed", F.lit(False))
    both = hits.unionByName(misses).withColumn("listed", F.coalesce("listed", F.lit(False)))
    verdict = F.coalesce("_ruled", F.when(F.col("listed"), "block").otherwise("allow"))
    return both.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "possible_hit", "listed")
