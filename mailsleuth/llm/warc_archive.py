"""Content-addressed WARC archive.

A record is split in two: its exact header block, and its payload. Payload bytes are stored once per
strong digest (SHA-256 and length); header blocks name the digest. Reading joins both again and checks
every stored payload against its digest.

Defined results: a null body is an empty payload; a null url is an empty target; a null page id is a record
of its own that revisits the smallest known id, or is a response if its group has no id at all; rows that
repeat both id and payload are the same record, so each gets the group's record type; an empty table gives an
empty archive; further columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

CRLF = "\r\n"
PAGE_URN = "urn:x-page:"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(hex_text: Column) -> Column:
    """Base32 (RFC 4648) of 40 hex digits: five of them make four letters."""
    parts = [F.lpad(F.conv(F.substr(hex_text, F.lit(i * 5 + 1), F.lit(5)), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def header_block(date: str) -> Column:
    """WARC/1.1 header block of one record, with its closing empty line."""
    field = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit(CRLF))
    urn = lambda c: F.concat(F.lit(f"<{PAGE_URN}"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    revisit = F.col("record_type") == "revisit"
    return F.concat(
        F.lit("WARC/1.1" + CRLF), field("WARC-Type", F.col("record_type")), field("WARC-Record-ID", urn("page_id")),
        field("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "")), field("WARC-Date", F.lit(date)),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(field("WARC-Refers-To", urn("response_id")), field("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        field("Content-Type", F.lit("application/octet-stream")),
        field("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("length").cast("string"))), F.lit(CRLF)).cast("binary")


def write_archive(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", body: str = "html",
                  least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Store ``pages`` below ``folder`` as two tables, ``payloads`` and ``headers``. Payloads shorter than
    ``least_bytes`` are never replaced by a revisit."""
    payload = F.encode(F.coalesce(F.col(body).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "length": F.octet_length("payload").cast("long"), "sha1": base32(F.sha1("payload"))})
    # both digests and the length are the key, so bytes that clash in one of them are still kept apart
    key = ["digest", "length", "sha1"]
    rows.groupBy(*key).agg(F.first("payload").alias("payload")).write.parquet(f"{folder}/payloads")
    first = rows.groupBy(*key).agg(F.min("page_id").alias("response_id"))
    again = (F.col("length") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    headers = (rows.drop("payload").join(first, key).withColumn("record_type", F.when(again, "revisit").otherwise("response"))
               .select("page_id", *key, header_block(date).alias("header")))
    headers.write.parquet(f"{folder}/headers")


def read_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Stored payloads, each checked against the digest it is stored under; a broken one stops the read."""
    key = ["digest", "length", "sha1"]
    whole = (F.sha2("payload", 256) == F.col("digest")) & (F.octet_length("payload") == F.col("length"))
    broken = F.raise_error(F.concat(F.lit("payload does not match its digest "), F.col("digest")))
    return spark.read.parquet(f"{folder}/payloads").select(*key, "payload", F.when(whole, base32(F.sha1("payload"))).otherwise(broken).alias("read_sha1"))


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """The records again: ``header`` fields parsed, ``payload`` by a join on the digest, and ``record`` with the
    exact bytes of the WARC record (a revisit has no block)."""
    text = F.decode("header", "UTF-8")
    field = lambda name, value: F.regexp_extract(text, f"\r\n{name}: {value}\r\n", 1)
    none = lambda c: F.when(c != "", c)
    heads = spark.read.parquet(f"{folder}/headers").select(
        "digest", "length", "sha1", "header", none(field("WARC-Record-ID", f"<{PAGE_URN}([^>]*)>")).alias("record_of"),
        field("WARC-Type", "(\\w+)").alias("record_type"), none(field("WARC-Refers-To", f"<{PAGE_URN}([^>]*)>")).alias("refers_to"),
        field("WARC-Payload-Digest", "sha1:(\\w+)").alias("payload_digest"), field("WARC-Target-URI", "([^\r]*)").alias("url"))
    joined = heads.join(read_payloads(spark, folder), ["digest", "length", "sha1"], "left")
    end = F.lit(CRLF + CRLF).cast("binary")
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit("").cast("binary"))
    return joined.withColumn("record", F.concat("header", block, end))


def export_warc(records: DataFrame, folder: str) -> None:
    """Plain .warc text files of UTF-8 payloads, one record after the other."""
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit("").cast("binary"))
    records.select(F.decode(F.concat("header", block), "UTF-8")).write.option("lineSep", CRLF + CRLF).text(folder)
