"""File sources and sinks, MIME decoding, streaming state."""

import time

from pyspark.sql import functions as F

from mailsleuth.operators import correlation, ingest
from mailsleuth.plans.fixtures import Views
from mailsleuth.sources import mail_files, tables
from mailsleuth.streaming import jobs

MAIL = (b"From: A <a@b.co>\r\nSubject: =?utf-8?q?caf=C3=A9?=\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=B\r\n\r\n"
        b"--B\r\nContent-Type: text/plain; charset=utf-8\r\n\r\nhello http://x.org/a\r\n--B\r\nContent-Type: text/html\r\n\r\n<p>hi</p>\r\n"
        b"--B\r\nContent-Type: image/png\r\nContent-Disposition: attachment; filename=\"q.png\"\r\n\r\nsee https://qr.example.org/z\r\n--B--\r\n")


def test_mail_folder(spark, tmp_path):
    (tmp_path / "one.eml").write_bytes(MAIL)
    (tmp_path / "two.eml").write_bytes(b"Subject: plain\n\nbody")
    (tmp_path / "skip.txt").write_bytes(b"no")
    files = mail_files.read_mail_files(spark, str(tmp_path))
    assert {r.file_name for r in mail_files.list_mail(files).collect()} == {"one.eml", "two.eml"}
    got = {r.message_id: r for r in mail_files.decode_mime(files.withColumn("message_id", F.substring_index("path", "/", -1))).collect()}
    assert got["one.eml"].text_body.strip() == "hello http://x.org/a" and got["one.eml"].has_html
    assert got["two.eml"].text_body == "body" and got["two.eml"].raw_headers == "Subject: plain\n"
    decoded = mail_files.decode_mime(files.withColumn("message_id", F.substring_index("path", "/", -1)))
    parts = mail_files.attachment_parts(decoded)
    cat = ingest.attachment_catalogue(parts).collect()
    assert [(r.filename, r.mime_type) for r in cat] == [("q.png", "image/png")]
    links = ingest.attachment_links(parts.withColumn("content", F.decode("content", "ISO-8859-1"))).collect()
    assert links[0].qr_urls == ["https://qr.example.org/z"] and links[0].quishing_score == 45


def test_encoded_words(spark):
    from mailsleuth.functions.header import decode_words
    df = spark.createDataFrame([("=?utf-8?q?caf=C3=A9?= x",), ("plain",)], "v string")
    assert [r[0] for r in df.select(decode_words(F.col("v"))).collect()] == ["café x", "plain"]


def test_network_csv_and_rule_files(spark, tmp_path):
    (tmp_path / "n.csv").write_text("network,country_code,country,city,asn,organization\n8.8.4.0/24,US,United States,X,1,O\n0.0.0.0/0,ZZ,Z,Z,,Z\n")
    got = {r.network: (r.start_ip, r.end_ip) for r in tables.with_range(tables.read_networks(spark, str(tmp_path / "n.csv"))).collect()}
    assert got == {"8.8.4.0/24": (134743040, 134743295), "0.0.0.0/0": (0, 4294967295)}
    rules = correlation.detection_rules(Views(spark, "/root/testdata/sf0.001").scans)
    tables.write_rules(rules, str(tmp_path / "rules"))
    assert spark.read.text(str(tmp_path / "rules" / "yara")).where(F.col("value").startswith("rule ")).count() == rules.count()


def test_store_schema_evolution(spark, tmp_path):
    path = str(tmp_path / "store")
    tables.write_table(spark.range(3).toDF("id"), path)
    tables.write_table(spark.range(3, 5).select(F.col("id"), F.lit("x").alias("extra")), path)
    assert sorted((r.id, r.extra) for r in tables.read_table(spark, path).collect()) == [(0, None), (1, None), (2, None), (3, "x"), (4, "x")]


def test_expiring_cache_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "cache_key string, value string"
    spark.createDataFrame([("8.8.8.8", "US"), ("8.8.8.8", "US"), ("10.0.0.1", None), ("10.0.0.1", None)], schema).coalesce(1).write.parquet(src)
    out = str(tmp_path / "out")
    stream = jobs.cached_lookups(spark.readStream.schema(schema).parquet(src))
    q = stream.writeStream.option("checkpointLocation", str(tmp_path / "cp")).format("parquet").option("path", out).start()
    # a processing-time job keeps running batches to expire state, so it is stopped once the input is through
    end = time.time() + 60
    while time.time() < end and not any(p["numInputRows"] for p in q.recentProgress):
        time.sleep(0.5)
    q.stop()
    rows = sorted((r.cache_key, r.hit, r.value) for r in spark.read.parquet(out).collect())
    assert rows == [("10.0.0.1", False, None), ("10.0.0.1", True, None), ("8.8.8.8", False, "US"), ("8.8.8.8", True, "US")]
