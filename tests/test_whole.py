"""Nothing is dropped or merged: null keys and states, repeated ids, many URLs, gaps, streams of several files."""

from pyspark.sql import functions as F

from mailsleuth.functions import header as H
from mailsleuth.operators import correlation, enforcement, indicators, scoring
from mailsleuth.operators.components import components
from mailsleuth.operators.skew import ordered_scan
from mailsleuth.sources import mail_files
from mailsleuth.streaming import jobs

HEAD = "From: a <a@x.example>\r\nSubject: hi\r\n"


def test_ordered_scan_keeps_null_keys_and_numbers(spark):
    rows = [("a", 1, 10), ("a", None, 5), ("a", 9000, None), ("a", 9001, 7), (None, 1, 1), (None, None, None)]
    df = spark.createDataFrame(rows, "key string, seq long, v long")
    got = {(r["key"], r["seq"]): r for r in ordered_scan(df, "key", "seq", ["v"], "v", parts=3).collect()}
    assert len(got) == 6
    assert [got["a", s]["row_no"] for s in (None, 1, 9000, 9001)] == [1, 2, 3, 4]
    assert got["a", 1]["prev"]["v"] == 5 and got["a", 9001]["prev"]["v"] is None and got["a", 9001]["last_known"] == 10


def test_message_without_status_is_decided(spark):
    df = spark.createDataFrame([(50, ["x"], None, None), (50, ["x"], "REJECTED", None)], "risk_score int, findings array<string>, status string, evaluation_error string")
    assert [r["decision"] for r in enforcement.decide(df).collect()] == ["REVIEW"]


def messages(spark, rows):
    return spark.createDataFrame([(*r, "", None) for r in rows], "message_id string, user_email string, raw_headers string, text_body string, html_body string, attachment_names string")


def test_mails_of_one_id_keep_their_own_score(spark):
    bad = "http://10.0.0.1/login http://10.0.0.2/login"
    df = messages(spark, [("m", "u1", HEAD, bad), ("m", "u2", HEAD, bad), ("m", "u3", HEAD, "hello")])
    got = {r["user_email"]: r["url_penalty"] for r in scoring.gateway_scores(df).collect()}
    assert len(got) == 3 and got["u1"] == got["u2"] > 0 == got["u3"]
    assert scoring.upload_scores(df).count() == 3


def test_every_url_is_scored(spark):
    body = " ".join(f"http://site{i}.example/a" for i in range(40)) + " http://10.0.0.1/login"
    row = scoring.gateway_scores(messages(spark, [("m", "u", HEAD, body)])).first()
    assert row["urls_scored"] == 41 and row["url_penalty"] > 0


def test_encoded_words(spark):
    raw = "From: =?utf-8?Q?J=C3=B6rg?= <j@x.example>\r\nSubject: =?utf-8?B?VXJnZW50?= =?utf-8?B?IG5vdGljZQ==?=\r\n"
    row = H.with_headers(spark.createDataFrame([(raw,), (HEAD,)], "raw_headers string")).collect()
    assert [(r["from_hdr"], r["subject"]) for r in row] == [("Jörg <j@x.example>", "Urgent notice"), ("a <a@x.example>", "hi")]


def test_attempts_with_gaps_and_repeats(spark):
    rows = [("a", 1, "failed", "e1"), ("a", 1, "failed", "e1"), ("a", 7, "failed", "e7"), ("b", 2, "failed", "x"), ("b", 5, "ok", None), ("b", 9, "failed", "late"), ("c", 4, "failed", "4"), ("c", 6, "failed", "6"), ("c", 8, "failed", "8"), ("c", 9, "ok", None)]
    df = spark.createDataFrame(rows, "message_id string, attempt_no int, outcome string, error_text string")
    got = {r["message_id"]: (r["retry_count"], r["status"], r["error_message"]) for r in enforcement.fold_attempts(df).collect()}
    assert got == {"a": (2, "QUEUED", "e7"), "b": (1, "READY_FOR_ANALYSIS", None), "c": (3, "FAILED", "8")}
    halves = enforcement.attempt_facts(df.where("attempt_no % 2 = 0")).unionByName(enforcement.attempt_facts(df.where("attempt_no % 2 = 1")))
    assert {r["message_id"]: (r["retry_count"], r["status"], r["error_message"]) for r in enforcement.attempt_states(halves).collect()} == got


def test_a_job_of_very_many_attempts(spark):
    """Half of all attempts are those of one job, and some repeat; only its first failures are ever together."""
    df = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("j"), F.col("id").cast("string"))).alias("message_id"), (F.col("id") % 9001 + 5).cast("int").alias("attempt_no"),
                                    F.lit("failed").alias("outcome"), F.concat(F.lit("e"), (F.col("id") % 9001).cast("string")).alias("error_text"))
    facts = enforcement.attempt_facts(df)
    assert facts.agg(F.max(F.size("failures"))).first()[0] == 3
    assert "WindowGroupLimit" in facts._jdf.queryExecution().executedPlan().toString()
    hot = enforcement.attempt_states(facts).where("message_id = 'hot'").first()
    assert (hot["status"], hot["retry_count"], hot["error_message"]) == ("FAILED", 3, "e2")


def test_mail_files_of_any_case_are_listed_and_read(spark, tmp_path):
    for name in ("a.eml", "b.EML", "sub/c.Eml", "d.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("Subject: x\n\nbody " + name)
    found = mail_files.read_mail_files(spark, str(tmp_path))
    assert sorted(r["file_name"] for r in mail_files.list_mail(found).collect()) == ["a.eml", "b.EML", "c.Eml"]
    bodies = mail_files.decode_mime(found.select(F.col("path").alias("message_id"), "content")).select("text_body").collect()
    assert sorted(r[0] for r in bodies) == ["body a.eml", "body b.EML", "body sub/c.Eml"]


def test_release_belongs_to_its_tenant(spark):
    held = spark.createDataFrame([("m", "t1", "q1", "QUARANTINED"), ("m", "t2", "q2", "QUARANTINED")], "message_id string, tenant_id string, quarantine_id string, status string")
    asked = spark.createDataFrame([(1, "m", "t1", "x"), (2, "m", "t2", "x"), (3, "m", "t3", "x"), (4, "m", "t1", "x")], "request_id long, message_id string, tenant_id string, requested_by string")
    got = {r["request_id"]: (r["quarantine_id"], r["result"]) for r in enforcement.release_results(asked, held, spark.createDataFrame([("m",)], "message_id string")).collect()}
    assert got == {1: ("q1", "RELEASED"), 2: ("q2", "RELEASED"), 3: ("q1", "CROSS_TENANT"), 4: ("q1", "ALREADY_RELEASED")}


def test_stored_null_key_is_known(spark):
    stored = spark.createDataFrame([(None, "a")], "subject string, sender string")
    new = spark.createDataFrame([(None, "a"), (None, "b"), (None, "b")], "subject string, sender string")
    assert [tuple(r) for r in indicators.unseen(new, stored, ["subject", "sender"]).collect()] == [(None, "b")]


def test_ingest_of_several_files_out_of_order(spark, tmp_path):
    kind = "message_id string, received_at timestamp"
    for i, (mid, at) in enumerate([("a", "2024-03-01"), ("b", "2024-03-09"), ("c", "2024-01-01"), ("a", "2024-03-20"), (None, "2024-02-01"), (None, "2024-02-02")]):
        spark.createDataFrame([(mid, at)], "message_id string, at string").select("message_id", F.to_timestamp("at").alias("received_at")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    jobs.run_ingest(stream, f"{tmp_path}/jobs", f"{tmp_path}/cp").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/jobs").select("message_id").collect()
    assert sorted(str(r[0]) for r in got) == ["None", "a", "b", "c"]


def test_components_of_a_long_chain(spark):
    edges = spark.range(1, 300).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    got = components(edges).collect()
    assert len(got) == 299 and {r["root"] for r in got} == {0}


def test_graph_has_all_urls(spark):
    df = spark.createDataFrame([(1, "2024-01-01", "a@x.example", "r@y.example", "s", ";".join(f"http://h{i}.example/" for i in range(6)), "Low Risk", 1)], "scan_id long, scan_time string, sender string, receiver string, subject string, urls_text string, verdict string, risk_score int")
    assert correlation.graph_nodes(df).where("node_group = 'url'").count() == 6
