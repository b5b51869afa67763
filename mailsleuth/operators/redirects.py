"""Captured redirect chains, in the two dialects of the URL page and the URL score."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import rules as R, url as U
from .skew import ordered_scan


def annotate_hops(hops: DataFrame) -> DataFrame:
    """Row-local flags of each hop."""
    src, dst = U.upload_url(F.col("source_url")), U.upload_url(F.col("destination_url"))
    df = hops.where((F.coalesce("source_url", F.lit("")) != "") & (F.coalesce("destination_url", F.lit("")) != ""))
    df = df.withColumns({"source_domain": U.upload_host(src), "destination_domain": U.upload_host(dst),
                         "_ss": U.scheme_of(src), "_ds": U.scheme_of(dst)})
    return df.withColumns({
        "is_cross_domain": F.col("source_domain") != F.col("destination_domain"),
        "is_upgrade": (F.col("_ss") == "http") & (F.col("_ds") == "https"),
        "is_downgrade": (F.col("_ss") == "https") & (F.col("_ds") == "http"),
        "is_short": U.upload_shortener(F.col("source_domain")) | U.upload_shortener(F.col("destination_domain")),
        "is_ip": U.is_ip_literal(F.col("destination_domain")), "is_risky_tld": U.suffix_match(F.col("destination_domain"), R.UPLOAD_TLDS) != "",
        "brand": U.token_brand(F.col("destination_domain"))}).drop("_ss", "_ds")


def chain_risk(hops: DataFrame) -> DataFrame:
    """Dialect A, one row per chain. A destination domain (or URL) met before, the start included, is a loop.

    "Met before" needs no ordered set: the start and all destinations are counted per chain and
    domain, and a count above one is a repeat. Every level combines on the map side, so a chain of
    any length is never held in one task."""
    df = annotate_hops(hops)
    start = F.min(F.struct("hop_no", "source_url", "source_domain"))
    flags = df.groupBy("chain_id").agg(
        start.alias("start"), F.max(F.struct("hop_no", "destination_url")).alias("end"), F.count(F.lit(1)).alias("total_hops"),
        F.bool_or("is_cross_domain").alias("has_cross_domain"), F.bool_or("is_upgrade").alias("has_upgrade"),
        F.bool_or("is_downgrade").alias("has_downgrade"), F.bool_or("is_short").alias("has_shortener"),
        F.bool_or("is_ip").alias("has_ip_destination"), F.bool_or("is_risky_tld").alias("has_risky_tld"),
        F.min_by("brand", F.when(F.col("brand").isNotNull(), F.col("hop_no"))).alias("brand"))
    starts = df.groupBy("chain_id").agg(start.alias("s"))
    visits = df.select("chain_id", F.col("destination_domain").alias("domain"), F.lower("destination_url").alias("url")).unionByName(
        starts.select("chain_id", F.col("s.source_domain").alias("domain"), F.lower(U.upload_url(F.col("s.source_url"))).alias("url")))
    repeats = (visits.groupBy("chain_id", "domain", "url").agg(F.count(F.lit(1)).alias("n"))
               .groupBy("chain_id", "domain").agg(F.sum("n").alias("domain_n"), F.max("n").alias("url_n"))
               .groupBy("chain_id").agg((F.max("domain_n") > 1).alias("has_loop"), (F.max("url_n") > 1).alias("url_loop")))
    df = flags.join(repeats, "chain_id")
    points = lambda c, n: F.when(c, n).otherwise(0)
    risk = (points(F.col("has_loop"), 40) + points(F.col("has_downgrade"), 35) + points(F.col("has_ip_destination"), 30)
            + points(F.col("has_risky_tld"), 25) + points(F.col("has_shortener"), 15) + points(F.col("has_cross_domain"), 10)
            + points(F.col("total_hops") > 3, 15))
    return df.select("chain_id", F.col("start.source_url").alias("original_url"), F.col("end.destination_url").alias("final_url"),
                     "total_hops", "has_loop", "url_loop", "has_cross_domain", "has_upgrade", "has_downgrade", "has_shortener",
                     "has_ip_destination", "has_risky_tld", "brand", F.least(F.lit(100), risk).alias("risk_score"))


def chain_risk_by_source(hops: DataFrame) -> DataFrame:
    """Dialect B, one row per chain: a source URL met twice is a loop; the previous destination is
    compared with this source, which is equal in an unbroken chain."""
    host = lambda c: F.lower(F.substring_index(U.netloc(F.col(c)), ":", 1))
    df = hops.withColumns({"_src": host("source_url"), "_dst": host("destination_url"), "_known": F.lit(1)})
    df = ordered_scan(df, "chain_id", "hop_no", ["_dst"], "_known")
    scheme = lambda c: U.scheme_of(F.col(c))
    crossed = F.coalesce((F.col("prev._dst") != "") & (F.col("_src") != "") & (F.col("prev._dst") != F.col("_src")), F.lit(False))
    df = df.withColumns({"_cross": crossed.cast("int"), "_down": ((scheme("source_url") == "https") & (scheme("destination_url") == "http")).cast("int")})
    per_source = df.groupBy("chain_id", "source_url").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_cross").alias("c"), F.sum("_down").alias("d"), F.min("hop_no").alias("first_no"))
    out = per_source.groupBy("chain_id").agg(
        F.sum("n").alias("redirect_count"), (F.max("n") > 1).alias("has_loop"), F.sum("c").alias("cross_domain_count"),
        F.sum("d").alias("https_downgrades"), F.min_by("source_url", "first_no").alias("original_url"))
    points = lambda c, n: F.when(c, n).otherwise(0)
    return out.withColumn("risk_score", F.least(F.lit(100), points(F.col("has_loop"), 35) + points(F.col("cross_domain_count") > 0, 25)
                                                + points(F.col("https_downgrades") > 0, 30) + points(F.col("redirect_count") >= 3, 20)))


def redirect_risk_by_url(hops: DataFrame) -> DataFrame:
    """(url, redirect_risk) for the URL score; the highest risk wins when a URL starts several chains."""
    return chain_risk_by_source(hops).groupBy(F.col("original_url").alias("url")).agg(F.max("risk_score").alias("redirect_risk"))


def chain_facts_by_url(hops: DataFrame) -> DataFrame:
    """What captured chains add to the URL verdict."""
    c = chain_risk(hops)
    return c.groupBy(F.col("original_url").alias("url")).agg(
        F.max("risk_score").alias("chain_risk"), F.bool_or("has_loop").alias("chain_loop"), F.bool_or("has_downgrade").alias("chain_downgrade"),
        F.bool_or("has_ip_destination").alias("chain_ip"), F.bool_or("has_risky_tld").alias("chain_tld"),
        F.bool_or(F.col("brand").isNotNull()).alias("chain_brand"), F.max_by(U.upload_host(U.upload_url(F.col("final_url"))), "chain_id").alias("final_host"))
