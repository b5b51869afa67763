"""Landed mail files: listing, reading, MIME decoding."""

from __future__ import annotations

import email
import email.policy
import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions import rules as R

FILE_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])


def read_mail_files(spark: SparkSession, folder: str) -> DataFrame:
    """All ``.eml`` files below a folder, in whatever case the suffix is; listing and reading are spread over the tasks."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", "*.[eE][mM][lL]").option("recursiveFileLookup", "true").load(folder))


def list_mail(files: DataFrame) -> DataFrame:
    """Accepted mail files, newest first; the content column is not read for a listing."""
    return (files.where(F.lower("path").endswith(".eml")).select(F.substring_index("path", "/", -1).alias("file_name"), "modificationTime", "length")
            .orderBy(F.col("modificationTime").desc(), F.col("file_name").desc()))


PART_SCHEMA = T.StructType([
    T.StructField("message_id", T.StringType()), T.StructField("raw_headers", T.StringType()), T.StructField("text_body", T.StringType()),
    T.StructField("html_body", T.StringType()), T.StructField("has_plain_text", T.BooleanType()), T.StructField("has_html", T.BooleanType()),
    T.StructField("attachments", T.ArrayType(T.StructType([
        T.StructField("pos", T.IntegerType()), T.StructField("original_filename", T.StringType()), T.StructField("mime_type", T.StringType()), T.StructField("content", T.BinaryType())])))])


def _text_of(part) -> str:
    try:
        got = part.get_content()
        return got if isinstance(got, str) else got.decode("utf-8", "replace")
    except Exception:
        return (part.get_payload(decode=True) or b"").decode("utf-8", "replace")


def _mail_policy(keep: int = 4096, longest: int = 1024) -> email.policy.EmailPolicy:
    """The default policy parses a header anew at every look at it, several times a part; this one keeps the last parsed headers,
    which most parts share, unless they are long."""
    parse = email.policy.default.header_factory
    kept = functools.lru_cache(keep)(parse)
    return email.policy.default.clone(header_factory=lambda name, value: (kept if len(value) <= longest else parse)(name, value))


def _decode_one(raw: bytes, max_parts: int | None, policy: email.policy.EmailPolicy) -> tuple:
    msg = email.message_from_bytes(raw, policy=policy)
    texts, pages, files = [], [], []
    for part in msg.walk():
        if part.is_multipart():
            continue
        kind, place, name = part.get_content_type(), str(part.get_content_disposition() or ""), part.get_filename()
        inline_file = "inline" in place and kind not in ("text/plain", "text/html")
        if "attachment" in place or name or inline_file:
            if max_parts is None or len(files) < max_parts:
                files.append((len(files), name or f"attachment_{len(files) + 1}.bin", kind, part.get_payload(decode=True) or b""))
        elif kind == "text/html":
            pages.append(_text_of(part))
        elif kind == "text/plain" or not msg.is_multipart():
            texts.append(_text_of(part))
    return "\n".join(texts), "\n".join(pages), bool(texts), bool(pages), files


def decode_mime(files: DataFrame, max_parts: int | None = None) -> DataFrame:
    """Bodies and attachments of raw messages (message_id, content); None keeps every part.

    This is the only stage that needs Python per message, as Spark has no MIME decoder. It runs as
    Arrow batches inside the scan's own tasks and shuffles nothing. The header block is cut off in the
    JVM and stays with the row."""
    head = F.regexp_extract(F.decode("content", "ISO-8859-1"), r"(?s)^(.*?\r?\n)\r?\n", 1)
    src = files.select("message_id", head.alias("raw_headers"), "content")

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        policy = _mail_policy()
        for pdf in it:
            rows = [_decode_one(bytes(c), max_parts, policy) for c in pdf["content"]]
            yield pd.DataFrame({
                "message_id": pdf["message_id"], "raw_headers": pdf["raw_headers"], "text_body": [r[0] for r in rows], "html_body": [r[1] for r in rows],
                "has_plain_text": [r[2] for r in rows], "has_html": [r[3] for r in rows],
                "attachments": [[dict(zip(("pos", "original_filename", "mime_type", "content"), f)) for f in r[4]] for r in rows]})

    return src.mapInPandas(batches, PART_SCHEMA)


def attachment_parts(decoded: DataFrame) -> DataFrame:
    """Long form (message_id, pos, original_filename, mime_type, content) for the attachment jobs."""
    return decoded.select("message_id", F.explode("attachments").alias("a")).select("message_id", "a.*")
