"""Header, recipient, URL and attachment tables of landed mail, and the gates before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import files, header as H, rules as R
from ..functions.text import blank, extract_all, unescape_html


def header_table(messages: DataFrame, raw: str = "raw_headers") -> DataFrame:
    """(message_id, pos, name, value); repeated names keep their own rows and values."""
    return (messages.select("message_id", F.posexplode(H.header_fields(F.col(raw))).alias("pos", "f"))
            .select("message_id", "pos", F.col("f.name").alias("name"), F.col("f.value").alias("value")))


def header_map(fields: Column) -> Column:
    """map<name, array<value>> of a parsed header block, built inside the row."""
    names = F.array_distinct(F.transform(fields, lambda f: F.lower(f["name"])))
    return F.map_from_entries(F.transform(names, lambda n: F.struct(n, F.transform(
        F.filter(fields, lambda f: F.lower(f["name"]) == n), lambda f: f["value"]))))


def effective_message_id(mid_header: Column, fallback: Column) -> Column:
    t = F.regexp_replace(mid_header, r"^[<> ]+|[<> ]+$", "")
    return F.when(t != "", t).otherwise(fallback)


def recipient_table(messages: DataFrame, raw: str = "raw_headers") -> DataFrame:
    df = messages.withColumn("fields", H.header_fields(F.col(raw)))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), H.recipients(H.first(F.col("fields"), k)).alias("list")) for k in ("To", "Cc", "Bcc")])
    return (df.select("message_id", F.explode(kinds).alias("k"))
            .select("message_id", F.col("k.kind").alias("kind"), F.posexplode("k.list").alias("pos", "address")))


def envelope_gate(df: DataFrame, col: str, allow_bounce: bool = True) -> DataFrame:
    return df.withColumn("accepted", H.valid_address(F.col(col), allow_bounce))


def message_gate(df: DataFrame, size: Column, limit: int = R.MAX_MESSAGE_BYTES) -> DataFrame:
    """``gate`` is null for accepted messages, otherwise the reply text."""
    return df.withColumn("gate", F.when(size > limit, "552 5.3.4 Message size exceeds fixed limit")
                         .when(F.coalesce(size, F.lit(0)) == 0, "550 5.6.0 Empty message payload"))


def gateway_urls(text: Column, html: Column) -> Column:
    """Distinct URLs of a mail in order of discovery: plain text, then links, then HTML text.

    Entities are decoded; rows without '&' in a URL never leave the JVM."""
    found = F.concat(extract_all(blank(text), R.RE_URL_GATEWAY), extract_all(blank(html), R.RE_HREF, 1),
                     extract_all(blank(html), R.RE_URL_GATEWAY))
    joined = F.array_join(found, "\n")
    decoded = F.coalesce(unescape_html(F.when(F.contains(joined, F.lit("&")), joined)), joined)
    cleaned = F.transform(F.split(decoded, "\n"), lambda u: F.regexp_replace(F.trim(u), r"""[.,;)>'"\]]+$""", ""))
    return F.array_distinct(F.filter(cleaned, lambda u: u != ""))


def upload_urls(body: Column, attached: Column | None = None) -> Column:
    """URLs of the body, then those of attachments, first occurrence kept."""
    found = extract_all(blank(body), R.RE_URL_UPLOAD)
    return F.array_distinct(found if attached is None else F.concat(found, F.coalesce(attached, F.array().cast("array<string>"))))


def url_table(messages: DataFrame, urls: Column) -> DataFrame:
    return messages.select("message_id", F.posexplode(urls).alias("pos", "url"))


def payload_urls(payload: Column, kind: str) -> Column:
    """URLs in the extracted text of a PDF or the bytes of an image (read as Latin-1 text)."""
    if kind == "pdf":
        found = F.transform(extract_all(blank(payload), R.RE_URL_PDF), lambda u: F.regexp_replace(u, r"[.,;!?)>]+$", ""))
        found = F.transform(found, lambda u: F.when(u.startswith("www."), F.concat(F.lit("http://"), u)).otherwise(u))
    else:
        found = F.transform(extract_all(blank(payload), R.RE_URL_IMAGE), lambda u: F.regexp_replace(u, r"""[\x00-\x1f\s"';,)>]+$""", ""))
        found = F.filter(found, lambda u: F.contains(u, F.lit("http://")) | F.contains(u, F.lit("https://")))
    return F.array_distinct(F.filter(found, lambda u: u != ""))


def attachment_catalogue(parts: DataFrame, max_count: int = R.MAX_ATTACHMENTS, max_bytes: int = R.MAX_ATTACHMENT_BYTES) -> DataFrame:
    """One row per (message, payload hash). Parts behind the 20th and above 25 MiB keep their row and hash;
    ``over_limit`` marks them.

    ``parts`` holds message_id, pos (0-based order in the message), original_filename, mime_type and
    content. The duplicate of a payload is dropped by aggregation on its hash."""
    df = parts.withColumn("size_bytes", F.octet_length("content"))
    df = df.withColumn("over_limit", (F.col("pos") >= max_count) | (F.col("size_bytes") > max_bytes))
    fallback = F.concat(F.lit("attachment_"), (F.col("pos") + 1).cast("string"), F.lit(".bin"))
    name = F.when(blank("original_filename") == "", fallback).otherwise(F.col("original_filename"))
    df = df.select("message_id", "pos", "over_limit", F.sha2(F.col("content").cast("binary"), 256).alias("sha256"), "size_bytes",
                   F.coalesce("mime_type", F.lit("application/octet-stream")).alias("mime_type"),
                   name.alias("original_filename"), files.safe_name(name, fallback).alias("filename"))
    return df.groupBy("message_id", "sha256").agg(F.min_by(F.struct("pos", "size_bytes", "mime_type", "original_filename", "filename", "over_limit"), "pos").alias("a")).select("message_id", "sha256", "a.*")


def attachment_links(parts: DataFrame) -> DataFrame:
    """URLs inside PDF text and image payloads, one row per part with at least one."""
    low = F.lower(blank("original_filename"))
    is_pdf = (F.col("mime_type") == "application/pdf") | low.endswith(".pdf")
    is_img = files.is_image(F.col("original_filename"), F.col("mime_type"))
    none = F.array().cast("array<string>")
    df = parts.withColumns({"is_pdf": is_pdf, "is_image": is_img,
                            "pdf_urls": F.when(is_pdf, payload_urls(F.col("content"), "pdf")).otherwise(none),
                            "qr_urls": F.when(is_img, payload_urls(F.col("content"), "image")).otherwise(none)})
    df = df.where((F.size("pdf_urls") > 0) | (F.size("qr_urls") > 0))
    return df.select("message_id", "pos", "original_filename", "pdf_urls", "qr_urls",
                     F.when(F.size("qr_urls") > 0, 45).otherwise(0).alias("quishing_score"))


def attachment_facts(parts: DataFrame, named: int = 3) -> DataFrame:
    """What the payloads of a message add to its score, one row per message: ``pdf_links`` and ``image_links`` (number of
    PDFs and images that hold links), ``link_findings`` in the order of the parts, of which a PDF's counts all its links
    and names the first ``named``, and the sorted ``hashes``. Parts without a message id belong to none."""
    known = parts.where(F.col("message_id").isNotNull())
    links = attachment_links(known).withColumns({"n_pdf": F.size("pdf_urls"), "n_image": F.size("qr_urls")})
    name = F.concat(F.lit("'"), blank("original_filename"), F.lit("'"))
    pdf = F.when(F.col("n_pdf") > 0, F.concat(F.lit("PDF "), name, F.lit(" holds links ("), F.col("n_pdf").cast("string"), F.lit("): "), F.array_join(F.slice("pdf_urls", 1, named), ", ")))
    image = F.when(F.col("n_image") > 0, F.concat(F.lit("Image "), name, F.lit(" leads to "), F.get("qr_urls", F.lit(0))))
    texts = F.array_sort(F.collect_list(F.struct("pos", F.array_compact(F.array(pdf, image)).alias("t"))))
    found = links.groupBy("message_id").agg(F.sum((F.col("n_pdf") > 0).cast("int")).cast("int").alias("pdf_links"), F.sum((F.col("n_image") > 0).cast("int")).cast("int").alias("image_links"), F.flatten(F.transform(texts, lambda x: x["t"])).alias("link_findings"))
    hashes = known.groupBy("message_id").agg(F.array_sort(F.collect_set(F.sha2(F.col("content").cast("binary"), 256))).alias("hashes"))
    return hashes.join(found, "message_id", "left").select("message_id", "hashes", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("pdf_links", "image_links")], F.coalesce("link_findings", F.array().cast("array<string>")).alias("link_findings"))


LINK_POINTS = {"pdf_links": 15, "image_links": 35}


def attachment_points(parts: Column) -> Column:
    """Points for the names of an array of ``named_parts``, not yet capped."""
    one = lambda x: F.when(files.dangerous_part(x), 35).otherwise(0) + F.when(files.double_part(x), 30).otherwise(0)
    return F.aggregate(parts, F.lit(0), lambda a, x: a + one(x))


def attachment_penalty(points: Column, *links: Column) -> Column:
    """Gateway attachment penalty: points for names, and for the numbers of PDFs and of images with links; 45 at most."""
    return F.least(F.lit(45), sum((F.coalesce(n, F.lit(0)) * p for n, p in zip(links, LINK_POINTS.values())), points).cast("int"))
