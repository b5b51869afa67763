"""Policy enforcement on append-only events with latest-wins views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import bands, rules as R
from ..session import stored
from .skew import latest


def decide(messages: DataFrame) -> DataFrame:
    """Decision, reason and final status of messages that are not in an end state yet. A message whose
    evaluation failed goes to REVIEW. Needs risk_score, findings array, status, evaluation_error."""
    df = messages.where(~F.coalesce("status", F.lit("")).isin(R.END_STATES))
    err = F.col("evaluation_error")
    return df.withColumns({
        "decision": F.when(err.isNotNull(), "REVIEW").otherwise(bands.decision(F.col("risk_score"))),
        "reason": F.when(err.isNotNull(), F.concat(F.lit("Security Analysis Evaluation Error: "), err))
                  .otherwise(bands.decision_reason(F.col("risk_score"), F.col("findings")))}).withColumn("final_status", bands.final_status(F.col("decision")))


def upsert_decisions(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored and new decisions as one table; the newest row per message wins."""
    both = stored.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    return latest(both, ["message_id"], F.col("decided_at"), F.col("_v")).drop("_v")


def quarantine_rows(decided: DataFrame, day: str = "yyyyMMdd") -> DataFrame:
    """One quarantine row per (message, tenant) of the QUARANTINE decisions."""
    df = decided.where(F.col("decision") == "QUARANTINE").dropDuplicates(["message_id", "tenant_id"])
    return df.select("message_id", "tenant_id", bands.quarantine_id(F.col("message_id"), F.col("tenant_id"), F.date_format("decided_at", day)).alias("quarantine_id"),
                     F.col("from_addr").alias("original_sender"), F.coalesce("recipient", F.lit("unknown")).alias("recipient"), "subject", "reason",
                     "risk_score", "severity", F.lit("QUARANTINED").alias("status"), "decided_at")


def audit_rows(decided: DataFrame, day: str = "yyyyMMdd") -> DataFrame:
    """One audit event per decision; that of a quarantine names its record."""
    record = F.when(F.col("decision") == "QUARANTINE", bands.quarantine_id(F.col("message_id"), F.col("tenant_id"), F.date_format("decided_at", day)))
    return decided.select("message_id", "tenant_id", F.col("decision").alias("action"), F.lit("system").alias("actor_id"), "risk_score", "severity",
                          F.to_json(F.struct(record.alias("quarantine_id"), "reason")).alias("details"), F.col("decided_at").alias("event_time"))


def release_results(requests: DataFrame, quarantine: DataFrame, messages: DataFrame) -> DataFrame:
    """Result of every release request: found, same tenant, first release of the record, message exists.

    A request means the record of its own tenant; only where that tenant has none, the message's first other
    record answers it. "Already released" is decided by the smallest valid request per record, an
    aggregation, not by a window over a record's requests. Needs request_id, message_id, tenant_id, requested_by."""
    own = quarantine.groupBy("message_id", "tenant_id").agg(F.min("quarantine_id").alias("own_id"), F.max_by("status", "quarantine_id").alias("q_status"))
    other = quarantine.groupBy("message_id").agg(F.min("quarantine_id").alias("other_id"))
    m = messages.select("message_id").distinct().withColumn("has_message", F.lit(True))
    df = requests.join(own, ["message_id", "tenant_id"], "left").join(other, "message_id", "left").join(m, "message_id", "left")
    df = df.withColumn("quarantine_id", F.coalesce("own_id", "other_id"))
    valid = F.col("own_id").isNotNull() & (F.col("q_status") != "RELEASED") & F.col("has_message")
    winners = df.where(valid).groupBy("own_id").agg(F.min("request_id").alias("winner"))
    df = df.join(winners, "own_id", "left")
    code = (F.when(F.col("quarantine_id").isNull(), "NOT_FOUND").when(F.col("own_id").isNull(), "CROSS_TENANT")
            .when((F.col("q_status") == "RELEASED") | (F.col("winner") < F.col("request_id")), "ALREADY_RELEASED")
            .when(F.col("has_message").isNull(), "MESSAGE_MISSING").otherwise("RELEASED"))
    return df.select("request_id", "message_id", "tenant_id", "requested_by", "quarantine_id", code.alias("result"))


QUARANTINE_ROW = "message_id string, tenant_id string, quarantine_id string, status string, changed_by long"


def release_batch(table, requests: DataFrame, messages: DataFrame, batch_id: int) -> DataFrame:
    """Results of a batch of release requests against the kept quarantine records (a ``KeyedTable`` of the row above,
    bucketed by message), whose released ones are then marked, so that a later batch finds them released. Only buckets
    of messages that are asked for are read."""
    held = table.read(requests)
    results = stored(release_results(requests, held, messages), "release-results")
    released = results.where(F.col("result") == "RELEASED").select("quarantine_id").distinct()
    marked = held.join(released, "quarantine_id", "left_semi").withColumns({"status": F.lit("RELEASED"), "changed_by": F.lit(batch_id).cast("long")})
    table.upsert(marked, batch_id)
    return results


def flow_states(messages: DataFrame, requests: DataFrame, quarantine: DataFrame) -> DataFrame:
    """State of each message after all requests (RELEASE, RELEASE_REVIEW, REJECT) in request order.

    RELEASE needs a quarantined record of the own tenant, RELEASE_REVIEW a message in REVIEW, REJECT is
    always taken. Between rejects the state can only rise to READY_FOR_RELAY, so the outcome follows
    from the last accepted reject and the first valid release, which are aggregates."""
    q = quarantine.select("message_id", "tenant_id").distinct().withColumn("held", F.lit(True))
    m = messages.select("message_id", F.col("final_status").alias("start"))
    df = requests.join(m, "message_id").join(q, ["message_id", "tenant_id"], "left")
    own = (F.col("action") == "RELEASE") & F.coalesce("held", F.lit(False))
    review = (F.col("action") == "RELEASE_REVIEW") & (F.col("start") == "REVIEW")
    reject = F.col("action") == "REJECT"
    at = lambda c: F.when(c, F.col("request_id"))
    f = df.groupBy("message_id").agg(F.first("start").alias("start"), F.min(at(own)).alias("release_at"), F.min(at(review)).alias("review_at"),
                                     F.min(at(reject)).alias("first_reject"), F.max(at(reject)).alias("last_reject"), F.count(F.lit(1)).alias("requests"))
    review_ok = F.col("review_at").isNotNull() & (F.col("first_reject").isNull() | (F.col("review_at") < F.col("first_reject")))
    best = F.greatest(F.coalesce("release_at", F.lit(-1)), F.when(review_ok, F.col("review_at")).otherwise(-1))
    return f.select("message_id", "start", "requests", F.when((best >= 0) & (best > F.coalesce("last_reject", F.lit(-1))), "READY_FOR_RELAY")
                    .when(F.col("last_reject").isNotNull(), "REJECTED").otherwise(F.col("start")).alias("state"))


def propagate_status(jobs: DataFrame, messages: DataFrame) -> DataFrame:
    """Queue rows take the status of their message; rows without a message keep theirs."""
    return jobs.join(messages.select("message_id", F.col("final_status").alias("_s")), "message_id", "left").withColumn(
        "status", F.coalesce("_s", "status")).drop("_s")


def fold_attempts(attempts: DataFrame, max_retries: int = R.MAX_RETRIES) -> DataFrame:
    """Queue state after all attempts (batch form of the streaming state machine).

    Attempts are ordered by ``attempt_no``, which may have gaps and repeats. The first success ends a
    job; the third failure before it fails the job for good; later attempts are ignored."""
    return attempt_states(attempt_facts(attempts, max_retries), max_retries)


def _first_failures(failures: DataFrame, n: int) -> DataFrame:
    """The first ``n`` of the rows message_id, no, text of each message, one for each number. Numbers are folded first, with
    the id and the number as key, and the limit on row numbers is applied before the shuffle too, so that a job with
    very many attempts brings no more than ``n`` rows from each task."""
    each = failures.groupBy("message_id", "no").agg(F.min("text").alias("text"))
    return each.withColumn("_rn", F.row_number().over(Window.partitionBy("message_id").orderBy("no"))).where(F.col("_rn") <= n).drop("_rn")


def _facts(first: DataFrame, ends: DataFrame) -> DataFrame:
    """message_id, ok_at, failures (array of no and text, in order) of every message in ``ends``."""
    lists = first.groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("no", "text"))).alias("failures")).withColumnRenamed("message_id", "_m")
    both = ends.join(lists, F.col("message_id").eqNullSafe(F.col("_m")), "left").drop("_m")
    return both.withColumn("failures", F.coalesce("failures", F.array().cast("array<struct<no:bigint,text:string>>")))


def attempt_facts(attempts: DataFrame, max_retries: int = R.MAX_RETRIES) -> DataFrame:
    """What counts of a job's attempts: the first success and the first ``max_retries`` failures. Facts of two sets
    of attempts merge into the facts of both, so they can be kept per batch."""
    at = F.col("attempt_no").cast("bigint")
    ends = attempts.groupBy("message_id").agg(F.min(F.when(F.col("outcome") == "ok", at)).alias("ok_at"))
    failed = attempts.where(F.col("outcome") == "failed").select("message_id", at.alias("no"), F.col("error_text").alias("text"))
    return _facts(_first_failures(failed, max_retries), ends)


def attempt_states(facts: DataFrame, max_retries: int = R.MAX_RETRIES) -> DataFrame:
    """Job states from facts (message_id, ok_at, failures), of one or of many batches."""
    ends = facts.groupBy("message_id").agg(F.min("ok_at").alias("ok_at"))
    failed = facts.select("message_id", F.explode("failures").alias("f")).select("message_id", "f.no", "f.text")
    f = _facts(_first_failures(failed, max_retries), ends)
    # failures after the first success do not count; the first ones of all are enough to know those before it
    f = f.withColumn("failures", F.filter("failures", lambda x: F.col("ok_at").isNull() | (x["no"] < F.col("ok_at"))))
    f = f.withColumns({"retry_count": F.size("failures").cast("bigint"), "last_error": F.get("failures", F.size("failures") - 1)["text"]})
    done = F.col("ok_at").isNotNull() & (F.col("retry_count") < max_retries)
    return f.select("message_id", "retry_count", F.when(F.col("retry_count") >= max_retries, "FAILED").when(done, "READY_FOR_ANALYSIS").otherwise("QUEUED").alias("status"),
                    F.when(~done, F.col("last_error")).alias("error_message"))


def relay_results(outcomes: DataFrame, messages: DataFrame) -> DataFrame:
    """Delivery result of messages ready for relay: their first attempt decides, as it leaves the ready state."""
    ready = messages.where(F.col("final_status") == "READY_FOR_RELAY").select("message_id", "tenant_id")
    first = outcomes.groupBy("message_id").agg(F.min(F.struct("attempt_no", "smtp_code", "relay_host")).alias("a"))
    df = ready.join(first, "message_id")
    ok = F.col("a.smtp_code") == 250
    return df.select("message_id", "tenant_id", F.col("a.relay_host").alias("relay_host"), F.col("a.smtp_code").alias("smtp_code"),
                     F.when(ok, "DELIVERED").otherwise("FAILED").alias("status"), F.when(ok, "DELIVERED").otherwise("DELIVERED_FAILED").alias("audit_action"), F.lit(1).alias("attempt_count"))


def audit_events(events: DataFrame, event: Column, actor: Column, target_type: Column | None = None) -> DataFrame:
    """Defaults of the audit trail: actor "System", target type by the event name."""
    auth = F.contains(event, F.lit("login")) | F.contains(event, F.lit("logout"))
    kind = F.when(auth, "auth").otherwise("system")
    return events.withColumns({"actor_name": F.coalesce(actor, F.lit("System")), "event": event,
                               "target_type": kind if target_type is None else F.coalesce(target_type, kind)})


def live_entries(cache: DataFrame, now: Column, ttl: Column) -> DataFrame:
    """Batch form of the expiring cache: entries whose time to live has not run out."""
    return cache.withColumn("expires_at", F.col("cached_at") + F.make_dt_interval(secs=ttl)).where(F.col("expires_at") >= now)
