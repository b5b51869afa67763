"""Batch ledger, ingest state and the event-time cache across batches, restarts, replays and half-written batches."""

import random

import pytest
from pyspark.sql import functions as F

from mailsleuth.operators import analyst, enforcement
from mailsleuth.sources.keyed_table import KeyedTable
from mailsleuth.streaming import jobs, ledger


def rows_of(spark, out, name):
    return sorted(tuple(r) for r in ledger.committed(spark, out, name).drop("batch_id").collect())


def test_batches_count_as_a_whole_and_once(spark, tmp_path):
    out = str(tmp_path / "tables")
    one, two = (spark.createDataFrame(rows, "k int, v string") for rows in ([(1, "a"), (2, "b")], [(3, "c")]))

    def both(put):
        kept = put("first", one)
        put("second", kept.where("k = 2"))

    assert ledger.ledger(spark, out).count() == 0
    assert ledger.commit_tables(spark, out, 0, both)
    assert rows_of(spark, out, "first") == [(1, "a"), (2, "b")] and rows_of(spark, out, "second") == [(2, "b")]
    assert not ledger.commit_tables(spark, out, 0, both)  # a replay

    def broken(put):
        put("first", two)
        raise RuntimeError("executor lost")

    with pytest.raises(RuntimeError):
        ledger.commit_tables(spark, out, 1, broken)
    assert rows_of(spark, out, "first") == [(1, "a"), (2, "b")] and not ledger.is_committed(spark, out, 1)
    assert ledger.commit_tables(spark, out, 1, lambda put: (put("first", two), put("second", two.limit(0))))
    assert rows_of(spark, out, "first") == [(1, "a"), (2, "b"), (3, "c")] and rows_of(spark, out, "second") == [(2, "b")]
    assert {(r["batch_id"], r["table_name"]): r["n_rows"] for r in ledger.ledger(spark, out).collect()} == {(0, "first"): 2, (0, "second"): 1, (1, "first"): 1, (1, "second"): 0}
    # a second driver commits its own attempt of batch 1: every reader takes the same one of the two
    spark.createDataFrame([("first", "0" * 32, 1)], "table_name string, attempt string, n_rows long").coalesce(1).write.mode("append").parquet(f"{out}/ledger/batch_id=1")
    assert {r["attempt"] for r in ledger.ledger(spark, out).where("batch_id = 1").collect()} == {"0" * 32}


def test_first_row_of_a_key_stays(spark):
    df = spark.createDataFrame([("m", "t", 1, 5), ("m", "t", 2, 3), (None, "t", 3, 1), ("n", None, 4, 0)], "k string, t string, v int, batch_id long")
    assert sorted((str(r[0]), str(r[1]), r[2]) for r in ledger.first_written(df, ["k", "t"]).collect()) == [("None", "t", 3), ("m", "t", 2), ("n", "None", 4)]


def test_tables_of_scored_messages(spark, tmp_path):
    out = str(tmp_path / "scored")
    head = "From: Boss <ceo@gmail.com>\r\nTo: u@corp.example.com, v@corp.example.com\r\nSubject: s\r\n"
    messages = spark.createDataFrame([(f"m{i}", head, "hello", "", "a.exe;a.exe;b.txt") for i in range(3)], "message_id string, raw_headers string, text_body string, html_body string, attachment_names string")
    messages = messages.withColumn("received_at", F.expr("timestamp'2024-05-01 10:00:00'"))
    parts = messages.select("message_id", F.posexplode(F.split("attachment_names", ";")).alias("pos", "original_filename"), F.lit(None).cast("string").alias("mime_type")).withColumn("content", F.col("original_filename").cast("binary"))
    for batch in (0, 1):  # the same mail lands twice
        assert ledger.commit_tables(spark, out, batch, lambda put: jobs.score_tables(messages, put, parts))
    counts = {name: (ledger.committed(spark, out, name).count(), jobs.scored_table(spark, out, name).count()) for name in jobs.TABLE_KEYS}
    assert counts["messages"] == counts["audit"] == (6, 3) and counts["attachments"] == (12, 6) and counts["scans"] == (6, 1)
    assert {r["recipient"] for r in jobs.scored_table(spark, out, "messages").collect()} == {"u@corp.example.com"}


def test_audit_names_the_quarantine_record(spark):
    rows = spark.createDataFrame([("m", "t", "QUARANTINE", 70, "HIGH", "why"), ("n", "t", "ALLOW", 1, "LOW", "ok")], "message_id string, tenant_id string, decision string, risk_score int, severity string, reason string")
    rows = rows.withColumns({"decided_at": F.expr("timestamp'2024-05-01 10:00:00'"), "from_addr": F.lit("f"), "recipient": F.lit(None).cast("string"), "subject": F.lit("s")})
    record = enforcement.quarantine_rows(rows).first()["quarantine_id"]
    assert {r["message_id"]: r["details"] for r in enforcement.audit_rows(rows).collect()} == {"m": f'{{"quarantine_id":"{record}","reason":"why"}}', "n": '{"reason":"ok"}'}


def land(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_ingest_state_outlives_restarts(spark, tmp_path):
    folder, schema = str(tmp_path / "in"), "message_id string, received_at timestamp_ntz"
    at = "timestamp_ntz'2024-01-01 00:00:00'"
    progress = []
    for day in range(3):
        ids = [f"m{i}" for i in range(day * 40, day * 40 + 50)] + ["same"] * 20 + [None]
        spark.createDataFrame([(i,) for i in ids], "message_id string").select("message_id", F.expr(at).alias("received_at")).coalesce(1).write.mode("append").parquet(folder)
        q = jobs.run_ingest(spark.readStream.schema(schema).parquet(folder), f"{tmp_path}/jobs", f"{tmp_path}/cp")
        q.awaitTermination()
        progress += [p for p in q.recentProgress if p["numInputRows"]]
    got = [r["message_id"] for r in spark.read.parquet(f"{tmp_path}/jobs").collect()]
    assert sorted(map(str, got)) == sorted({f"m{i}" for i in range(130)} | {"same", "None"})
    # a batch takes in its own rows alone, however many ids are known; these are in the state, in RocksDB
    assert [p["numInputRows"] for p in progress] == [71] * 3
    state = [p["stateOperators"][0] for p in progress]
    assert [s["numRowsTotal"] for s in state] == [52, 92, 132] and all("rocksdbCommitFlushLatency" in s["customMetrics"] for s in state)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("RocksDBStateStoreProvider")


def test_answers_expire_between_batches(spark, tmp_path):
    folder, schema = str(tmp_path / "in"), "cache_key string, request_id long, requested_at string, value string"
    days = [[("a", 1, "2024-01-01 10:00:00", "US"), ("a", 2, "2024-01-01 10:30:00", "DE"), ("b", 3, "2024-01-01 10:00:00", None), ("b", 4, "2024-01-01 10:05:00", "FR"), (None, 5, "2024-01-01 10:00:00", "x")],
            [("a", 6, "2024-01-01 11:00:00", "GB"), ("b", 7, "2024-01-01 10:05:01", "FR"), ("c", 8, "2024-01-01 11:00:00", "IT")],
            [("a", 9, "2024-01-01 11:00:01", "GB"), ("z", 10, "2024-01-02 00:00:00", None)],
            [("c", 11, "2024-01-02 00:00:00", "ES"), ("z", 12, "2024-01-02 00:05:00", "PT")],
            [("z", 13, "2024-01-05 00:00:00", "PT")], [("z", 14, "2024-01-05 00:00:01", None)]]
    kept = []
    for rows in days:
        spark.createDataFrame(rows, schema).withColumn("requested_at", F.col("requested_at").cast("timestamp")).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema.replace("requested_at string", "requested_at timestamp")).parquet(folder)
        q = jobs.run_cache(stream, f"{tmp_path}/out", f"{tmp_path}/cp")
        q.awaitTermination()
        kept.append([p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]][-1])
    got = {r["request_id"]: (r["hit"], r["value"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {1: (False, "US"), 2: (True, "US"), 3: (False, None), 4: (True, None), 5: (False, "x"), 6: (True, "US"), 7: (False, "FR"), 8: (False, "IT"),
                   9: (False, "GB"), 10: (False, None), 11: (False, "ES"), 12: (True, None), 13: (False, "PT"), 14: (True, "PT")}
    assert kept[-1] < max(kept)  # timers have removed what has expired


def test_live_counters_in_any_order(spark, tmp_path):
    """Rows and corrections land shuffled over files, a correction before the row that it takes back among them."""
    rng = random.Random(7)
    schema = "user_id long, verdict string, risk_score long, sign long"
    scans = [(rng.choice([None, 1, 2, 3]), rng.choice(["High Risk", "Low Risk"]), rng.randrange(100)) for _ in range(60)]
    wrong = [(4, "High Risk", 50)] + [(u, "High Risk", 99) for u, _, _ in scans[:9]]
    rows = [(*r, 1) for r in scans + wrong] + [(*r, -1) for r in wrong]
    rng.shuffle(rows)
    results = []
    for name, files in (("a", 1), ("b", 4)):
        for n in range(files):
            land(spark, f"{tmp_path}/in-{name}", rows[n::files], schema)
        table = KeyedTable(spark, f"{tmp_path}/kept-{name}", analyst.ANALYST_ROW, ["user_id"], ["step"], buckets=2, max_deltas=1)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in-{name}")
        jobs.run_counters(stream, ["user_id"], analyst.analyst_sums(), table, f"{tmp_path}/cp-{name}").awaitTermination()
        results.append(sorted(map(tuple, analyst.live_analyst_counters(table.read()).collect())))
    batch = analyst.analyst_counters(spark.createDataFrame(scans, "user_id long, verdict string, risk_score long"))
    assert results[0] == results[1] == sorted(map(tuple, batch.select("user_id", "total", "high_risk", "average_score").collect()))
    assert 4 not in {r[0] for r in results[0]}
