"""Indicators: extraction, search, reputation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import ip as IP, rules as R, text as TX, url as U
from ..session import stored
from ..sources.gram_index import every_gram, fits, rarest_gram, term_grams, values_of


def with_indicators(messages: DataFrame, text: Column, urls: Column | None = None, hashes: Column | None = None) -> DataFrame:
    """Six sorted distinct arrays per message, found inside the row without a shuffle."""
    df = messages.withColumn("_txt", text)
    empty = F.array().cast("array<string>")
    found = lambda pat: TX.extract_all(F.col("_txt"), pat)
    return df.withColumns({
        "ip_addresses": TX.sorted_set(F.filter(F.concat(found(R.RE_IPV4), found(R.RE_IPV6)), lambda a: ~a.startswith("127.") & (a != "0.0.0.0"))),
        "domains": TX.sorted_set(F.filter(found(R.RE_DOMAIN), lambda d: (F.length(d) <= 253) & ~d.endswith(".local"))),
        "urls": TX.sorted_set(urls if urls is not None else empty), "email_addresses": TX.sorted_set(found(R.RE_EMAIL)),
        "hashes": TX.sorted_set(hashes if hashes is not None else empty), "crypto_wallets": TX.sorted_set(found(R.RE_WALLET))}).drop("_txt")


def with_hashes(df: DataFrame, attachments: DataFrame) -> DataFrame:
    """The sets above with the hashes of the attachments (``ingest.attachment_facts``), joined to the narrow rows."""
    narrow = df.select("message_id", *[c for _, c in KINDS if c != "hashes"])
    both = narrow.join(stored(attachments.select("message_id", "hashes"), "attachment-hashes"), "message_id", "left")
    return both.withColumn("hashes", F.coalesce("hashes", F.array().cast("array<string>")))


KINDS = [("ip", "ip_addresses"), ("domain", "domains"), ("url", "urls"), ("email", "email_addresses"), ("hash", "hashes"), ("wallet", "crypto_wallets")]


def indicator_table(df: DataFrame) -> DataFrame:
    """Long form (message_id, ioc_type, ioc_value); a message's arrays are distinct already."""
    kinds = F.array(*[F.struct(F.lit(k).alias("t"), F.col(c).alias("v")) for k, c in KINDS])
    return df.select("message_id", F.explode(kinds).alias("k")).select("message_id", F.col("k.t").alias("ioc_type"), F.explode("k.v").alias("ioc_value"))


def sightings(iocs: DataFrame) -> DataFrame:
    return iocs.groupBy("ioc_type", "ioc_value").agg(F.count(F.lit(1)).alias("sightings"))


def classify_terms(terms: DataFrame, col: str = "term") -> DataFrame:
    """Type, private flag, hashes and entropy of search terms."""
    t = F.col(col)
    df = IP.with_ip_flags(terms, t, "_f")
    quad, hexa = t.rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"), t.rlike(r"^[a-fA-F0-9]+$")
    kind = (F.when(quad, "IPv4 Address").when((F.length(t) == 32) & hexa, "Cryptographic Hash (MD5)")
            .when((F.length(t) == 64) & hexa, "Cryptographic Hash (SHA-256)").otherwise("Domain / Hostname"))
    raw = t.cast("binary")
    return df.withColumns({
        "ioc_type": kind, "is_private_ip": quad & IP.restricted(F.col("_f")), "md5": F.md5(raw), "sha1": F.sha1(raw), "sha256": F.sha2(raw, 256),
        "domain_entropy": F.round(U.entropy(F.substring_index(F.lower(t), ":", 1)), 2)}).drop("_f")


def scan_text() -> Column:
    """What a term search looks at in a scan, as one text."""
    return F.lower(F.concat_ws("\u0001", "urls_text", "iocs_text", "sender", F.coalesce("subject", F.lit(""))))


def held_values(terms: DataFrame, values: DataFrame) -> DataFrame:
    """term, value of the distinct texts that hold a term, without an index: the texts are cut up for this search."""
    own = term_grams(terms)
    held = values.select("value", F.explode(every_gram(F.col("value"))).alias("gram")).join(own.select("gram").distinct(), "gram")
    held = stored(held, "held-grams")
    rarest = stored(rarest_gram(own, held.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))), "rarest-grams")
    return held.join(rarest, "gram").where(fits()).select("term", "value")


def scans_with(terms: DataFrame, hay: DataFrame) -> DataFrame:
    """term, scan_id of the scans with a column that holds the rarest gram of a term, and the term where one column can. Columns
    repeat from scan to scan, so terms meet their distinct values, and the scans come by these."""
    entries = stored(hay.select("scan_id", F.explode(values_of(F.col("hay"))).alias("value")), "scan-values")
    held = stored(held_values(terms, stored(entries.select("value").distinct(), "values")), "held-values")
    return entries.join(held, "value").select("term", "scan_id").distinct()


def search_terms(terms: DataFrame, scans: DataFrame, limit: int | None = None, index=None) -> DataFrame:
    """Bulk indicator search: for each distinct term the scans with the term in urls, indicators, sender or subject,
    all or the newest ``limit`` of them, then the count of all matches, score and verdict.

    Substring search becomes an equi-join: a term is looked up by the rarest of its own grams (runs of 1 to 3
    characters) among the distinct column values, and the full test follows on those candidates only. ``index`` is a kept ``GramIndex`` of ``scan_text``;
    without one the scans are cut up for this search.
    The newest scans come from a row-number limit, which Spark applies before its shuffle too."""
    t = classify_terms(terms.select("term").distinct())
    hay = scans.select("scan_id", "scan_time", scan_text().alias("hay"))
    low = F.lower("term")
    candidates = scans_with(t.select("term"), hay) if index is None else index.candidates(t.select("term")).select("term", F.col("id").alias("scan_id"))
    matched = candidates.join(hay, "scan_id").where(F.contains(F.col("hay"), low)).select("term", "scan_id", "scan_time")
    newest = Window.partitionBy("term").orderBy(F.col("scan_time").desc(), F.col("scan_id").desc())
    top = matched if limit is None else matched.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= limit)
    listed = top.groupBy("term").agg(F.array_sort(F.collect_list("scan_id")).alias("scan_ids"))
    found = matched.groupBy("term").agg(F.count(F.lit(1)).alias("matches_count"))
    df = t.join(found, "term", "left").join(listed, "term", "left").withColumn("matches_count", F.coalesce("matches_count", F.lit(0)))
    hit = F.col("matches_count") > 0
    return df.withColumns({"reputation_score": F.when(hit, 85).otherwise(0), "verdict": F.when(hit, "Threat Record Found").otherwise("Clean / No Threats Recorded")})


# --- fixed values: which indicator types a feed kind speaks about -----------------------------
FEED_TYPES = {"ip_feed": ["ip"], "url_feed": ["url", "domain"], "payload_feed": ["url", "domain", "hash"],
              "multi_feed": ["url", "domain", "ip", "hash", "email"]}


def reputation(iocs: DataFrame, feed: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Votes per distinct indicator from all feeds that apply to its type and have not expired.
    An indicator that no feed knows keeps unknown = 1 and confidence 0.5."""
    distinct = iocs.select("ioc_type", "ioc_value").distinct()
    applies = F.lit(False)
    for provider, types in FEED_TYPES.items():
        applies = applies | ((F.col("provider") == provider) & F.col("ioc_type").isin(types))
    live = feed.where(applies) if as_of is None else feed.where(applies & (F.col("expires_at") >= as_of))
    votes = live.groupBy("ioc_type", "ioc_value").agg(
        *[F.sum(c).alias(c) for c in ("malicious", "suspicious", "harmless", "unknown")], F.max("confidence").alias("confidence"), F.count_distinct("provider").alias("providers"))
    df = distinct.join(votes, ["ioc_type", "ioc_value"], "left")
    known = F.col("providers").isNotNull()
    return df.select("ioc_type", "ioc_value", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("malicious", "suspicious", "harmless")],
                     F.when(known, F.col("unknown")).otherwise(1).cast("bigint").alias("unknown"), F.coalesce("confidence", F.lit(0.5)).alias("confidence"),
                     F.coalesce("providers", F.lit(0)).cast("bigint").alias("providers"))


def unseen(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not stored yet; duplicates inside the batch collapse to one. A null key equals a stored
    null key, so a row without a subject is not inserted again by every run."""
    known = existing.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return new.dropDuplicates(keys).join(known, same, "left_anti")
