"""Analyst layer: visibility, search, facets, counters, exports, backfill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import bands, rules as R
from ..session import stored
from .skew import attach_unique


def list_of(c: str) -> Column:
    """Array of a ';'-joined text column, empty for empty text."""
    return F.filter(F.split(F.coalesce(F.col(c), F.lit("")), ";"), lambda x: x != "")


def json_list(c: str) -> Column:
    """JSON text list with the fallback for broken or missing text."""
    return F.coalesce(F.from_json(F.col(c), "array<string>"), F.array().cast("array<string>"))


def visible(scans: DataFrame, user_id: int | None) -> DataFrame:
    own = F.col("user_id").isNull()
    return scans.where(own if user_id is None else own | (F.col("user_id") == user_id))


def with_submitter(scans: DataFrame, users: DataFrame) -> DataFrame:
    """Left join to the users. One submitter may own a third of the scans and many scans have none, so
    the hot-key safe join is used."""
    df = attach_unique(scans, users.select("user_id", "username", "email"), ["user_id"])
    return df.withColumn("submitted_by", F.coalesce("username", F.lit("Public visitor")))


_PUBLIC_WORDS = ["public", "visitor", "anon", "guest", "unassigned"]
_SEARCHED = ["subject", "sender", "receiver", "reply_to", "urls_text", "iocs_text", "username", "email"]


def history_text(scans: DataFrame, users: DataFrame) -> DataFrame:
    """id and text of every scan for the index of the history search."""
    return with_submitter(scans, users).select(F.col("scan_id").alias("id"), F.concat_ws("\u0001", *_SEARCHED).alias("text"))


def search_history(scans: DataFrame, users: DataFrame, term: str = "", verdict: str = "", category: str = "", user_id: int | None = None, index=None) -> DataFrame:
    """Visible scans that hold the term in one of eight columns, carry its number as id, or have no
    owner when the term asks for public ones; then verdict and category. Newest first.

    The verdict test and the visibility test sit directly on the scan and reach the file reader. With a kept
    ``GramIndex`` of ``history_text``, the columns are looked into only for scans that hold the rarest gram of the term;
    a term that asks for public scans is not looked up, as these need not hold it."""
    df = visible(scans, user_id)
    if index is not None and term.strip() and not any(w in term.lower() for w in _PUBLIC_WORDS):
        ids = index.candidates(scans.sparkSession.createDataFrame([(term.strip(),)], "term string")).select("id")
        if term.strip().isdigit():
            ids = ids.unionByName(scans.sparkSession.createDataFrame([(int(term),)], "id long"))
        df = stored(df.join(ids, F.col("scan_id") == F.col("id"), "left_semi"), "candidates")  # looked up once, read for hot keys and for the join
    if verdict in R.VERDICTS:
        df = df.where(F.col("verdict") == verdict)
    if category:
        df = df.where(F.array_contains(list_of("categories_text"), category))
    df = with_submitter(df, users)
    term = term.strip()
    if term:
        test = F.lit(False)
        for c in _SEARCHED:
            test = test | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(term.lower())), F.lit(False))
        if term.isdigit():
            test = test | (F.col("scan_id") == int(term))
        if any(w in term.lower() for w in _PUBLIC_WORDS):
            test = test | F.col("user_id").isNull()
        df = df.where(test)
    return df.orderBy(F.col("scan_time").desc(), F.col("scan_id").desc())


def category_facets(scans: DataFrame, user_id: int | None = None) -> DataFrame:
    return (visible(scans, user_id).select(F.explode(list_of("categories_text")).alias("category"))
            .groupBy("category").agg(F.count(F.lit(1)).alias("scans")).orderBy("category"))


def search_users(users: DataFrame, term: str = "", role: str = "") -> DataFrame:
    df = users
    if term.strip():
        t = F.lit(term.strip().lower())
        df = df.where(F.contains(F.lower("username"), t) | F.contains(F.lower("email"), t))
    if role in R.ROLES:
        df = df.where(F.col("role") == role)
    return df.orderBy(F.col("created_at").desc(), F.col("user_id").desc())


def admin_counters(users: DataFrame, scans: DataFrame, decided: DataFrame, quarantine: DataFrame, received: DataFrame) -> DataFrame:
    """All eight counters; one pass per table, joined as one-row results through a union and a final sum."""
    names = ["users", "scans", "high_risk", "total_received", "allowed", "review", "quarantined", "rejected"]
    def part(df, **counts):
        got = df.agg(*[v.alias(k) for k, v in counts.items()])
        return got.select(*[F.col(n) if n in counts else F.lit(0).cast("bigint").alias(n) for n in names])
    n = F.count(F.lit(1))
    both = (part(users, users=n).unionByName(part(scans, scans=n, high_risk=F.count_if(F.col("verdict") == "High Risk")))
            .unionByName(part(received, total_received=n))
            .unionByName(part(decided, allowed=F.count_if(F.col("decision") == "ALLOW"), review=F.count_if(F.col("final_status") == "REVIEW"), rejected=F.count_if(F.col("decision") == "REJECT")))
            .unionByName(part(quarantine, quarantined=F.count_if(F.col("status") == "QUARANTINED"))))
    return both.agg(*[F.sum(c).alias(c) for c in names])


def analyst_counters(scans: DataFrame) -> DataFrame:
    """Total, high-risk count and half-even rounded mean score per user."""
    return scans.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("verdict") == "High Risk").alias("high_risk"),
        F.bround(F.avg("risk_score"), 0).cast("bigint").alias("average_score"))


def analyst_sums() -> dict[str, Column]:
    """What the analyst counters add up over change rows."""
    return {"total": F.lit(1), "high_risk": (F.col("verdict") == "High Risk").cast("long"), "score_sum": F.col("risk_score").cast("long")}


# the row that a kept table of these sums has
ANALYST_ROW = "user_id long, total long, high_risk long, score_sum long, step long"


def live_analyst_counters(kept: DataFrame) -> DataFrame:
    """The counters from kept sums; a user whose scans were all taken back has none."""
    mean = F.col("score_sum").cast("double") / F.col("total")
    return kept.where((F.col("total") > 0) & F.col("user_id").isNotNull()).select("user_id", "total", "high_risk", F.bround(mean, 0).cast("bigint").alias("average_score"))


def newest(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def work_batch(jobs: DataFrame, n: int) -> DataFrame:
    """Oldest waiting jobs first."""
    return jobs.where(F.col("status").isin("QUEUED", "RECEIVED")).orderBy("received_at", "message_id").limit(n)


def history_export(scans: DataFrame, users: DataFrame) -> DataFrame:
    """The ten fixed columns of the CSV export."""
    df = with_submitter(scans, users)
    return df.select(F.col("scan_id").alias("Scan ID"), F.date_format("scan_time", "yyyy-MM-dd'T'HH:mm:ss").alias("Scanned at"), F.col("submitted_by").alias("Submitted by"),
                     F.col("sender").alias("Sender"), F.col("receiver").alias("Recipient"), F.col("subject").alias("Subject"), F.col("risk_score").alias("Score"),
                     F.col("verdict").alias("Verdict"), F.array_join(list_of("categories_text"), "; ").alias("Categories"), F.array_join(list_of("urls_text"), "; ").alias("URLs"))


def report_json(scans: DataFrame) -> DataFrame:
    """One JSON document per scan: id, time, mail facts, analysis."""
    mail = F.struct(F.coalesce("sender", F.lit("Unknown sender")).alias("from"), F.coalesce("receiver", F.lit("Unknown recipient")).alias("to"),
                    F.coalesce("subject", F.lit("(no subject)")).alias("subject"), F.coalesce("reply_to", F.lit("")).alias("reply_to"), list_of("urls_text").alias("urls"))
    analysis = F.struct(F.col("risk_score").alias("score"), "verdict", list_of("findings_text").alias("findings"), list_of("categories_text").alias("categories"))
    return scans.select("scan_id", F.to_json(F.struct("scan_id", F.date_format("scan_time", "yyyy-MM-dd'T'HH:mm:ss").alias("scanned_at"),
                                                      mail.alias("email"), analysis.alias("analysis"))).alias("report"))


def backfill_scans(legacy: DataFrame, existing: DataFrame) -> DataFrame:
    """Legacy rows whose id is not stored yet, with defaults, clamped score, recomputed verdict, UTC time.

    An offset in the time text is applied; a text without one is UTC. The result has epoch seconds."""
    df = legacy.join(existing.select(F.col("scan_id").alias("id")), "id", "left_anti")
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(F.col("risk_score").try_cast("int"), F.lit(0))))
    t = F.col("scan_time_text")
    x = lambda i: F.regexp_extract(t, r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}):(\d{2}):(\d{2})(?:\.\d+)?(?:Z|([+-])(\d{2}):?(\d{2}))?$", i)
    num = lambda i: F.coalesce(x(i).try_cast("bigint"), F.lit(0))
    shift = F.when(x(5) == "-", -1).otherwise(1) * (num(6) * 3600 + num(7) * 60)
    epoch = F.unix_date(x(1).try_cast("date")).cast("bigint") * 86400 + num(2) * 3600 + num(3) * 60 + num(4) - shift
    df = df.withColumn("risk_score", score)
    return df.select("id", "user_id", "subject", "risk_score", F.when(F.col("verdict").isin(R.VERDICTS), F.col("verdict")).otherwise(bands.verdict(F.col("risk_score"))).alias("verdict"),
                     json_list("categories_json").alias("categories"), epoch.alias("scan_epoch"))


def backfill_users(legacy: DataFrame, existing: DataFrame) -> DataFrame:
    df = legacy.join(existing.select("user_id"), "user_id", "left_anti")
    return df.select("user_id", F.coalesce("username", F.lit("Unknown user")).alias("username"),
                     F.coalesce("email", F.concat(F.lit("migrated-"), F.col("user_id").cast("string"), F.lit("@invalid.local"))).alias("email"),
                     F.when(F.col("role").isin(R.ROLES), F.col("role")).otherwise("user").alias("role"))


def evolve(df: DataFrame, added: dict[str, tuple[str, object]]) -> DataFrame:
    """Add missing columns (name -> type, default) and fill the default where the value is absent."""
    for name, (kind, default) in added.items():
        value = F.lit(default).cast(kind)
        df = df.withColumn(name, F.coalesce(F.col(name).cast(kind), value) if name in df.columns else value)
    return df


def quarantine_list(quarantine: DataFrame, tenant: str, status: str | None = None) -> DataFrame:
    df = quarantine.where(F.col("tenant_id") == tenant)
    return (df if status is None else df.where(F.col("status") == status)).orderBy(F.col("decided_at").desc(), F.col("quarantine_id").desc())
