"""URL inventory, URL scores and URL verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import bands, rules as R, url as U
from ..session import stored
from .skew import HOT_SHARE, attach_unique


def with_url_risk(df: DataFrame, col: str = "url", redirect_risk: Column | None = None) -> DataFrame:
    """Components plus ``url_risk_score``, ``risk_level`` and ``url_findings`` of a URL column."""
    df = U.url_parts(df, col)
    host = F.col("hostname")
    df = df.withColumns({
        "url_entropy": U.entropy(F.col("normalized_url")), "host_entropy": U.entropy(host), "path_entropy": U.entropy(F.col("path")),
        "base64_payload": U.base64_payload(F.col("query")), "is_punycode": U.is_punycode(host), "lookalike": U.lookalike_brand(host),
        "is_shortener": U.gateway_shortener(host, F.col("root_domain")), "tld": U.suffix_match(host, R.GATEWAY_TLDS),
        "download_suffix": U.suffix_match(F.lower("path"), R.URL_DOWNLOADS)})
    df = df.withColumn("is_high_entropy", (F.col("host_entropy") > 4.8) | (F.col("path_entropy") > 5.2))
    rules = [
        (F.col("has_credentials"), 50, F.lit("Embedded Credentials in URL")),
        (F.col("numeric_ip_type").isNotNull(), 35, F.concat(F.lit("Obfuscated "), F.col("numeric_ip_type"), F.lit(" Target"))),
        (F.col("numeric_ip_type").isNull() & F.col("is_ip"), 30, F.lit("Raw IP Address URL Target")),
        (F.col("lookalike").isNotNull(), 40, F.concat(F.lit("Brand Impersonation Target: "), F.col("lookalike"))),
        (F.col("is_punycode"), 35, F.lit("Punycode (IDN) Encoded Domain Target")),
        (F.col("tld") != "", 20, F.concat(F.lit("Suspicious Top-Level Domain ("), F.col("tld"), F.lit(")"))),
        (F.col("is_shortener"), 15, F.lit("URL Shortener Service Detected")),
        (F.col("is_high_entropy"), 15, F.lit("High Shannon Entropy / Randomness")),
        (F.col("base64_payload"), 20, F.lit("Base64 Encoded Query Parameter Payload")),
        (F.col("download_suffix") != "", 30, F.concat(F.lit("Direct Executable / Archive File Download ("), F.col("download_suffix"), F.lit(")"))),
    ]
    score = F.lit(0) if redirect_risk is None else F.coalesce(redirect_risk, F.lit(0))
    for cond, points, _ in rules:
        score = score + F.when(cond, points).otherwise(0)
    df = df.withColumns({
        "url_risk_score": F.when(F.col("is_valid"), F.least(F.lit(100), score)).otherwise(0).cast("int"),
        "url_findings": F.when(F.col("is_valid"), F.array_compact(F.array(*[F.when(c, t) for c, _, t in rules])))
                        .otherwise(F.array().cast("array<string>"))})
    return df.withColumn("risk_level", bands.url_level(F.col("url_risk_score")))


def url_inventory(urls: DataFrame) -> DataFrame:
    """One row per distinct URL with its number of occurrences."""
    return urls.where(F.col("url").isNotNull()).groupBy("url").agg(F.count(F.lit(1)).alias("occurrences"))


def url_scores(urls: DataFrame, redirect_summary: DataFrame | None = None) -> DataFrame:
    """Scores of the distinct URLs, with their occurrences; ``redirect_summary`` (url, redirect_risk) comes from captured
    chains."""
    inventory = url_inventory(urls)
    if redirect_summary is None:
        return with_url_risk(inventory)
    return with_url_risk(inventory.join(redirect_summary, "url", "left"), redirect_risk=F.col("redirect_risk"))


def score_back(urls: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores joined to every occurrence. A URL that a third of all mails carry does not hurt: the few hot URLs follow
    from the occurrences that the stored scores hold, and are served by broadcast."""
    known = stored(scores.select("url", "url_risk_score", "risk_level", "occurrences"), "url-scores")
    hot = known.where(F.col("occurrences") * HOT_SHARE > known.agg(F.sum("occurrences")).scalar()).select("url")
    return attach_unique(urls, known.drop("occurrences"), ["url"], hot)


def message_url_penalty(scored: DataFrame, max_urls: int | None = None) -> DataFrame:
    """Penalty of the URLs of each message: 25 from score 50, 10 from score 25, at most 45. ``max_urls`` None
    takes all of them."""
    points = F.when(F.col("url_risk_score") >= 50, 25).when(F.col("url_risk_score") >= 25, 10).otherwise(0)
    counted = scored if max_urls is None else scored.where(F.col("pos") < max_urls)
    return counted.groupBy("message_id").agg(
        F.least(F.lit(45), F.sum(points)).alias("url_penalty"), F.count(F.lit(1)).alias("urls_scored"))


def url_verdicts(urls: DataFrame, chains: DataFrame | None = None) -> DataFrame:
    """Static verdict of a URL table: flags of the rules, number of suspicious ones, verdict and score.

    ``chains`` (url, chain_risk, chain_loop, chain_downgrade, chain_ip, chain_tld, chain_brand, final_host)
    holds what captured redirect chains add."""
    df = urls if chains is None else urls.join(chains, "url", "left")
    df = df.withColumn("_t", U.upload_url(F.col("url")))
    df = df.withColumn("_h", U.upload_host(F.col("_t")))
    chain = lambda c: F.lit(False) if chains is None else F.coalesce(F.col(c), F.lit(False))
    last_host = F.lit("") if chains is None else F.coalesce(F.col("final_host"), F.lit(""))
    risk = F.lit(0) if chains is None else F.coalesce(F.col("chain_risk"), F.lit(0))
    tld = U.suffix_match(F.col("_h"), R.UPLOAD_TLDS)
    df = df.withColumns({
        "rule_ip": U.is_ip_literal(U.netloc(F.col("_t"))) | chain("chain_ip"),
        "rule_brand": U.token_brand(F.col("_h")).isNotNull() | U.token_brand(last_host).isNotNull() | chain("chain_brand"),
        "rule_tld": (tld != "") | (U.suffix_match(last_host, R.UPLOAD_TLDS) != "") | chain("chain_tld"),
        "rule_entropy": F.round(U.entropy(F.col("_h")), 2) > 4.2,
        "rule_redirect": (risk >= 30) | chain("chain_loop") | chain("chain_downgrade"),
        "secure_scheme": F.col("_t").startswith("https://") & ~chain("chain_downgrade")})
    count = sum((F.col(c).cast("int") for c in ("rule_ip", "rule_brand", "rule_tld", "rule_entropy", "rule_redirect")), F.lit(0))
    df = df.withColumn("suspicious_rules", count)
    n = F.col("suspicious_rules")
    return df.withColumns({
        "verdict": F.when(n >= 2, "High Risk").when(n == 1, "Medium Risk").otherwise("Low Risk"),
        "risk_score": F.when(n >= 2, 85).when(n == 1, 45).otherwise(5),
        "md5": F.md5(F.col("_t").cast("binary")), "sha1": F.sha1(F.col("_t").cast("binary")), "sha256": F.sha2(F.col("_t").cast("binary"), 256)}).drop("_t", "_h")


def host_rollup(scores: DataFrame) -> DataFrame:
    """Risk per registered host over the whole inventory."""
    return scores.groupBy("hostname").agg(
        F.count(F.lit(1)).alias("urls"), F.sum("occurrences").alias("occurrences"), F.max("url_risk_score").alias("max_risk"),
        F.round(F.avg("url_risk_score"), 4).alias("avg_risk"))
