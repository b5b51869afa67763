"""Streaming jobs. They call the same table jobs as the batch side."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import bands, rules as R
from ..functions.header import recipients
from ..operators import enforcement, ingest, scoring
from ..sources import mail_files
from . import ledger


def started(w, spark: SparkSession, checkpoint: str, once: bool = True):
    """Start a stream whose state, if any, is kept by RocksDB: on the executors' disks, in files by hash bucket with a Bloom
    filter each, of which a batch opens those that its keys can be in; a checkpoint adds what has changed."""
    kept = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, value in STATE_STORE.items():
        spark.conf.set(k, value)
    try:
        w = w.option("checkpointLocation", checkpoint)
        return (w.trigger(availableNow=True) if once else w).start()
    finally:
        for k, value in kept.items():
            spark.conf.unset(k) if value is None else spark.conf.set(k, value)


STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
               "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}


def run_ingest(landed: DataFrame, out: str, checkpoint: str, event_time: str = "received_at", once: bool = True):
    """Ingest queue: one QUEUED job per message id, for ever and whatever the mail's age. The ids seen are keyed state
    without a watermark, so a batch costs what it brings and reads nothing of the jobs written before. A batch's repeats
    of an id meet its first one; the file sink lists a batch once, also where it is replayed."""
    jobs = landed.select("message_id", F.col(event_time).alias("received_at")).dropDuplicates(["message_id"])
    jobs = jobs.select("message_id", F.lit("QUEUED").alias("status"), "received_at", F.lit(0).alias("retry_count"))
    return started(jobs.writeStream.format("parquet").option("path", out), landed.sparkSession, checkpoint, once)


def signed(rows: DataFrame, corrected: DataFrame | None = None) -> DataFrame:
    """Change rows for live counters: rows that are new count once, rows that a correction takes back count minus one."""
    added = rows.withColumn("sign", F.lit(1).cast("long"))
    return added if corrected is None else added.unionByName(corrected.withColumn("sign", F.lit(-1).cast("long")))


COUNTER_STEP = "step"


def run_counters(changes: DataFrame, keys: list[str], sums: dict[str, Column], table, checkpoint: str, once: bool = True):
    """Live counters: sums over change rows (``sign`` 1 or -1) per key, kept as running state. Every micro-batch puts the new
    sums of the keys that it touched into ``table`` (a ``KeyedTable`` by these keys with a column ``step``). The order in
    which rows and corrections land makes no difference, and no row is ever too late."""
    running = changes.groupBy(*keys).agg(*[F.sum(F.col("sign") * c).alias(name) for name, c in sums.items()])

    def write(batch: DataFrame, batch_id: int) -> None:
        table.upsert(batch.withColumn(COUNTER_STEP, F.lit(batch_id).cast("long")), batch_id)
    return started(running.writeStream.outputMode("update").foreachBatch(write), changes.sparkSession, checkpoint, once)


def score_batch(messages: DataFrame, tenant_id: str = "default") -> DataFrame:
    """Score and decide a set of messages; used by the batch job and by every micro-batch."""
    scored = scoring.gateway_scores(messages, also=("to_hdr", "reply_to"))
    ready = scored.drop("decision", "reason").withColumns({"status": F.lit("READY_FOR_ANALYSIS"), "evaluation_error": F.lit(None).cast("string"), "tenant_id": F.lit(tenant_id)})
    return enforcement.decide(ready)


MESSAGE = ["message_id", "tenant_id", "from_addr", "recipient", "reply_to", "subject", "risk_score", "severity", "recommendation", "findings", "decision", "reason", "final_status", "decided_at"]


def score_tables(messages: DataFrame, put, parts: DataFrame | None = None, tenant_id: str = "default") -> None:
    """All tables that a scored set of messages leaves: messages, scans of the dashboard, quarantine, audit and, where
    ``parts`` holds the attachments (see ``ingest.attachment_catalogue``), attachments. Messages are scored once; the
    tables that follow are made from the stored scores."""
    decided = score_batch(messages, tenant_id)
    at = F.col("received_at") if "received_at" in decided.columns else F.current_timestamp()
    decided = decided.withColumns({"from_addr": F.col("from_hdr"), "recipient": F.get(recipients(F.col("to_hdr")), F.lit(0)), "decided_at": at})
    decided = put("messages", decided.select(*MESSAGE))
    scans = decided.select(F.col("from_addr").alias("sender"), F.coalesce("recipient", F.lit("unknown@target.local")).alias("receiver"), "subject", "reply_to", "risk_score", bands.scan_verdict(F.col("severity")).alias("verdict"), "findings", "message_id")
    put("scans", scans)
    put("quarantine", enforcement.quarantine_rows(decided))
    put("audit", enforcement.audit_rows(decided))
    if parts is not None:
        put("attachments", ingest.attachment_catalogue(parts))


# a row that is there already stays as it is
TABLE_KEYS = {"messages": ["message_id", "tenant_id"], "scans": ["subject", "sender"], "quarantine": ["message_id", "tenant_id"], "attachments": ["message_id", "sha256"], "audit": ["message_id", "tenant_id", "action"]}


def scored_table(spark: SparkSession, out: str, name: str) -> DataFrame:
    """A table of the scoring stream: what committed batches hold, the first row of each key."""
    return ledger.first_written(ledger.committed(spark, out, name), TABLE_KEYS[name])


def run_scoring_stream(messages: DataFrame, out: str, checkpoint: str, parts=None, once: bool = True):
    """Score a stream of messages into the tables above, of which each micro-batch commits all or none. ``parts`` makes
    the attachment parts of a batch; by default they are taken from a column ``attachments`` of decoded mail."""
    def write(batch: DataFrame, batch_id: int) -> None:
        own = parts(batch) if parts else mail_files.attachment_parts(batch) if "attachments" in batch.columns else None
        ledger.commit_tables(batch.sparkSession, out, batch_id, lambda put: score_tables(batch, put, own))
    w = messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def run_retries(attempts: DataFrame, out: str, checkpoint: str, once: bool = True):
    """Retry machine: each micro-batch stores what counts of its attempts (first success, first failures) in its own
    batch partition; ``retry_states`` merges them. Nothing here needs Python workers or a state store."""
    def write(batch: DataFrame, batch_id: int) -> None:
        enforcement.attempt_facts(batch).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
    w = attempts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def retry_states(spark: SparkSession, out: str) -> DataFrame:
    """Job states after all batches: QUEUED until a success or the third failure; a finished job ignores the rest."""
    return enforcement.attempt_states(spark.read.parquet(out))


_CACHE_OUT = T.StructType([T.StructField("cache_key", T.StringType()), T.StructField("hit", T.BooleanType()), T.StructField("value", T.StringType())])


class ExpiringCache(StatefulProcessor):
    """Lookup cache per key: an answer stays for an hour, a missing answer for five minutes; the state
    store drops expired entries itself."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        one = T.StructType([T.StructField("value", T.StringType())])
        self.good = handle.getValueState("good", one, ttlDurationMs=R.POSITIVE_TTL_SECONDS * 1000)
        self.bad = handle.getValueState("bad", one, ttlDurationMs=R.NEGATIVE_TTL_SECONDS * 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for pdf in rows:
            for value in pdf["value"]:
                held = self.good if self.good.exists() else self.bad if self.bad.exists() else None
                if held is None:
                    known = value is not None and value == value
                    (self.good if known else self.bad).update((value if known else "",))
                    out.append((key[0], False, value if known else None))
                else:
                    out.append((key[0], True, held.get()[0] or None))
        yield pd.DataFrame(out, columns=["cache_key", "hit", "value"])

    def close(self) -> None:
        pass


def cached_lookups(requests: DataFrame) -> DataFrame:
    """Stream (cache_key, value) to (cache_key, hit, value) through the expiring cache."""
    return requests.groupBy("cache_key").transformWithStateInPandas(ExpiringCache(), outputStructType=_CACHE_OUT, outputMode="Append", timeMode="ProcessingTime")


_LOOKUP = T.StructType([T.StructField("cache_key", T.StringType()), T.StructField("request_id", T.LongType()), T.StructField("hit", T.BooleanType()), T.StructField("value", T.StringType()), T.StructField("valid_until", T.TimestampType())])


class LookupCache(StatefulProcessor):
    """Lookup cache per key in event time. A request up to the end of a kept answer gets that answer; a later one gets
    its own, which is then kept, for an hour or, where it is empty, for five minutes. A timer removes an answer once
    the watermark has passed its end."""

    def __init__(self, good: int = R.POSITIVE_TTL_SECONDS, bad: int = R.NEGATIVE_TTL_SECONDS):
        self.good, self.bad = good, bad

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", T.StructType([T.StructField("value", T.StringType()), T.StructField("until", T.LongType())]))

    @staticmethod
    def after(until: int) -> int:
        """Millisecond at which no request can meet the answer any more."""
        return until // 1000 + 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        asked = pd.concat([pdf[["request_id", "requested_at", "value"]] for pdf in rows]).sort_values(["requested_at", "request_id"])
        times = asked["requested_at"].astype("datetime64[us]").astype("int64")
        # every call on the state is a round trip to the JVM: one to read, none where nothing changes
        value, until = self.kept.get() or (None, None)
        before, out = until, []
        for number, at, own in zip(asked["request_id"], times, asked["value"]):
            hit = until is not None and at <= until
            if not hit:
                value = own if isinstance(own, str) else None
                until = at + (self.good if value is not None else self.bad) * 1_000_000
            out.append((key[0], number, hit, value, until))
        if until != before:
            if before is not None:
                self.handle.deleteTimer(self.after(before))
            self.kept.update((value, until))
            self.handle.registerTimer(self.after(until))
        found = pd.DataFrame(out, columns=_LOOKUP.fieldNames())
        yield found.assign(valid_until=pd.to_datetime(found["valid_until"], unit="us"))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.kept.clear()
        return iter(())

    def close(self) -> None:
        pass


def run_cache(requests: DataFrame, out: str, checkpoint: str, late: str = "1 hour", once: bool = True):
    """Stream of requests (cache_key, request_id, requested_at, value found now) through the cache above. The answers
    kept are keyed state; a request that lands more than ``late`` behind the newest is too late to be answered."""
    found = requests.withWatermark("requested_at", late).groupBy("cache_key").transformWithStateInPandas(LookupCache(), outputStructType=_LOOKUP, outputMode="Append", timeMode="EventTime")
    return started(found.writeStream.format("parquet").option("path", out), requests.sparkSession, checkpoint, once)


def drain(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over everything that has landed and stop. Update-mode rows are kept per batch."""
    w = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        q = w.format("parquet").option("path", out).start()
    else:
        def write(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        q = w.outputMode(mode).foreachBatch(write).start()
    q.awaitTermination()
