"""The two composite scores. All facts of a message that need only its own row are computed in one
projection chain; the URLs are exploded, scored in place and folded back with one shuffle, in which
each message is already a single row thanks to the map-side combine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import bands, files, header as H, rules as R, text as TX, url as U
from ..session import stored, text_batches
from .ingest import LINK_POINTS, attachment_penalty, attachment_points, gateway_urls, upload_urls
from .urls import with_url_risk


def names_array(c: str = "attachment_names") -> Column:
    return F.filter(F.split(TX.blank(c), ";"), lambda n: n != "")


def text_lures(df: DataFrame, text: Column, prefix: str = "lure") -> DataFrame:
    """Add counts, points, score, level and tactics of the lure lists found in ``text``."""
    df = df.withColumn("_lt", F.lower(text))
    # flat columns: a struct of counts would be taken apart and counted again by every use
    df = df.withColumns({f"_p_{key}": F.least(F.lit(100), TX.hit_count(F.col("_lt"), terms) * pts) for key, pts, _, _, terms in R.LURES})
    points = {key: F.col(f"_p_{key}") for key, *_ in R.LURES}
    df = df.withColumn(f"{prefix}_score", TX.lure_score(points))
    return df.withColumns({f"{prefix}_points": F.struct(*[c.alias(key) for key, c in points.items()]), f"{prefix}_level": TX.lure_level(F.col(f"{prefix}_score"), F.col("_lt")),
                           f"{prefix}_tactics": TX.lure_tactics(points)}).drop("_lt", *[f"_p_{key}" for key in points])


def with_content_text(df: DataFrame) -> DataFrame:
    """Add ``_ct``, the text that the content patterns are searched in, to messages with parsed headers."""
    text_batches(df.sparkSession)
    return df.withColumn("_ct", TX.content_text(F.concat(F.col("subject"), F.lit("\n"), TX.blank("text_body"), F.lit("\n"), TX.blank("html_body"))))


def gateway_profile(messages: DataFrame, lure_text: str = "subject") -> DataFrame:
    """Every gateway penalty except the URLs, row-local. ``lure_text`` is ``subject`` (as the gateway
    scores) or ``full`` (subject and body)."""
    # both Python stages come first: above them the plan is plain columns, which the optimizer handles in seconds
    df = with_content_text(H.with_headers(messages))
    df = H.sender_penalty_parts(H.header_profile(df, raw=None))
    lure = F.concat(F.col("subject"), F.lit(" "), TX.blank("text_body") if lure_text == "full" else F.lit(""))
    df = text_lures(df, lure)
    df = df.withColumns({"content_labels": TX.content_labels(F.col("_ct")), "_auth": H.auth_results(F.col("auth_first")),
                         "attachments": names_array()}).drop("_ct")
    df = df.withColumns({**{p: F.col(f"_auth.{p}.status") for p in ("spf", "dkim", "dmarc")}, "_parts": files.named_parts(F.col("attachments"))})
    tail = lambda c: F.regexp_replace(F.lower(F.substring_index(c, "@", -1)), r"^[> ]+|[> ]+$", "")
    df = df.withColumns({"_rp": tail(F.col("return_path")), "_fd": tail(F.col("from_hdr"))})
    rp, fd = F.col("_rp"), F.col("_fd")
    rp_apart = (F.col("return_path") != "") & (F.col("from_hdr") != "") & (rp != "") & (fd != "") & (rp != fd)
    header_texts = F.concat(F.transform("header_findings", lambda f: f["finding"]), F.array_compact(F.array(F.when(
        rp_apart, F.concat(F.lit("Return-Path domain ("), rp, F.lit(") mismatch with From domain ("), fd, F.lit(")"))))))
    spf, dkim, dmarc = (F.col(p) for p in ("spf", "dkim", "dmarc"))
    df = df.withColumns({
        "_ht": header_texts,
        "auth_penalty": F.when(spf.isin("FAIL", "SOFTFAIL"), 20).otherwise(0) + F.when(dkim == "FAIL", 20).otherwise(0) + F.when(dmarc == "FAIL", 25).otherwise(0),
        "_at": F.array_compact(F.array(
            F.when(spf.isin("FAIL", "SOFTFAIL"), F.concat(F.lit("SPF authentication status: "), spf)),
            F.when(dkim == "FAIL", "DKIM signature validation FAILED"), F.when(dmarc == "FAIL", "DMARC alignment validation FAILED"))),
        "sender_penalty": F.when(F.col("g_homograph"), 30).otherwise(0) + F.when(F.col("g_name_brand").isNotNull(), 35).otherwise(0)
                          + F.when(F.col("g_reply_mismatch"), 20).otherwise(0) + F.when(F.col("g_tld") != "", 15).otherwise(0),
        "_st": F.array_compact(F.array(
            F.when(F.col("g_homograph"), F.concat(F.lit("Sender domain uses Punycode/IDN visual homograph: "), F.col("g_from_domain"))),
            F.when(F.col("g_name_brand").isNotNull(), F.concat(F.lit("Display Name impersonation detected: '"), F.col("g_display_name"), F.lit("' claims brand '"),
                                                               F.col("g_name_brand"), F.lit("' but domain is '"), F.col("g_from_domain"), F.lit("'"))),
            F.when(F.col("g_reply_mismatch"), F.concat(F.lit("Reply-To domain ("), F.col("g_reply_domain"), F.lit(") does not match From domain ("), F.col("g_from_domain"), F.lit(")"))),
            F.when(F.col("g_tld") != "", F.concat(F.lit("Sender domain uses suspicious TLD: "), F.col("g_tld"))))),
        "content_penalty": F.least(F.lit(40), F.floor(F.col("lure_score") / 2).cast("int") + F.size("content_labels") * 5),
        "_cc": F.transform("content_labels", lambda l: F.concat(F.lit("Content indicator detected: "), l)),
        "_tt": attachment_texts(F.col("_parts")), "name_points": attachment_points(F.col("_parts"))})
    df = df.withColumn("attachment_penalty", attachment_penalty(F.col("name_points")))
    df = df.withColumn("header_penalty", F.least(F.lit(35), F.size("_ht") * 12))
    return df.withColumn("row_findings", F.concat("_ht", "_at", "_st", "_cc")).drop("_auth", "_ht", "_at", "_st", "_cc", "_parts", "_rp", "_fd").withColumnRenamed("_tt", "attachment_findings")


def attachment_texts(parts: Column) -> Column:
    """Findings of an array of ``named_parts``."""
    one = lambda x: F.array_compact(F.array(
        F.when(files.dangerous_part(x), F.concat(F.lit("Attachment '"), x["s"], F.lit("' has executable/dangerous extension ("), x["ss"], F.lit(")"))),
        F.when(files.double_part(x), F.concat(F.lit("Attachment '"), x["s"], F.lit("' uses double extension deception (."), files.inner_suffix(x), x["ss"], F.lit(")")))))
    return F.flatten(F.transform(parts, one))


PENALTIES = ["header_penalty", "auth_penalty", "sender_penalty", "content_penalty", "url_penalty", "attachment_penalty"]


def url_findings(messages: DataFrame, redirect_summary: DataFrame | None = None, max_urls: int | None = None) -> DataFrame:
    """URLs of ``_urls`` in each message with their score and findings. A URL's redirects come by a join with a stored
    table, so that Spark can split a URL that sits in very many mails."""
    urls = F.col("_urls")
    rest = [c for c in messages.columns if c != "_urls"]
    df = messages.select(*rest, F.posexplode_outer(urls if max_urls is None else F.slice(urls, 1, max_urls)).alias("pos", "url"))
    if redirect_summary is not None:
        df = df.join(stored(redirect_summary, "redirect-risks"), "url", "left")
    df = with_url_risk(df, redirect_risk=F.coalesce(F.col("redirect_risk"), F.lit(0)) if redirect_summary is not None else None)
    label = F.concat(F.lit("URL ["), F.col("url"), F.lit("]: "))
    return df.withColumn("url_texts", F.transform("url_findings", lambda t: F.concat(label, t)))


def gateway_scores(messages: DataFrame, redirect_summary: DataFrame | None = None, lure_text: str = "subject", max_urls: int | None = None, also: tuple[str, ...] = (),
                   attachments: DataFrame | None = None, findings: bool = True) -> DataFrame:
    """One row per row of ``messages``, also where ids repeat: the six penalties, score, severity,
    recommendation, policy decision. ``max_urls`` None scores all URLs of a mail; ``also`` names further columns of
    the profile to keep. ``redirect_summary`` (url, redirect_risk) and ``attachments`` (``ingest.attachment_facts``) add
    what captured redirects and the payloads say; both are joined to narrow rows, without headers and bodies. Without
    ``findings`` the texts and facts behind the score, and the reason made of them, are left out and never worked out: what
    is carried through the aggregation is worked out for every row, wanted later or not."""
    df = gateway_profile(messages.withColumn("_urls", gateway_urls(F.col("text_body"), F.col("html_body"))), lure_text)
    keep = ["header_penalty", "auth_penalty", "sender_penalty", "content_penalty", "attachment_penalty", "name_points", "spf", "dkim", "dmarc",
            "row_findings", "attachment_findings", "header_security_score", "lure_score", "g_from_domain", "subject", "from_hdr", *also]
    if not findings:
        keep = [*(p for p in PENALTIES if p != "url_penalty"), "name_points", "subject", "from_hdr", *also]
    extra = [c for c in ("received_at", "doc_id", "user_email") if c in messages.columns]
    df = df.select("message_id", F.monotonically_increasing_id().alias("_row"), F.struct(*keep, *extra).alias("m"), "_urls")
    df = url_findings(df, redirect_summary, max_urls)
    points = F.when(F.col("url_risk_score") >= 50, 25).when(F.col("url_risk_score") >= 25, 10).otherwise(0)
    texts = F.when(F.col("url").isNotNull(), F.struct(F.col("pos"), F.col("url_texts").alias("t")))
    # a row's URLs share its own row number, so first() sees one value only
    df = df.groupBy("_row", "message_id").agg(
        F.first("m").alias("m"), F.least(F.lit(45), F.sum(points)).cast("int").alias("url_penalty"), F.count("url").alias("urls_scored"),
        *([F.array_sort(F.collect_list(texts)).alias("_u")] if findings else []))
    df = df.select("message_id", "m.*", "url_penalty", "urls_scored", *([F.flatten(F.transform("_u", lambda u: u["t"])).alias("url_findings")] if findings else []))
    if attachments is not None:
        df = df.join(stored(attachments, "attachment-facts"), "message_id", "left")
        df = df.withColumn("attachment_penalty", attachment_penalty(F.col("name_points"), *[F.col(c) for c in LINK_POINTS]))
        if findings:
            df = df.withColumn("attachment_findings", F.concat("attachment_findings", F.coalesce("link_findings", F.array().cast("array<string>"))))
        df = df.drop("link_findings")
    total = sum((F.col(p) for p in PENALTIES[1:]), F.col(PENALTIES[0]))
    df = df.withColumn("risk_score", bands.clamp(total))
    df = df.withColumns({"severity": bands.severity(F.col("risk_score")), "recommendation": bands.recommendation(F.col("risk_score")),
                         "decision": bands.decision(F.col("risk_score"))})
    if findings:
        df = df.withColumn("findings", F.concat("row_findings", "url_findings", "attachment_findings"))
        df = df.withColumn("reason", bands.decision_reason(F.col("risk_score"), F.col("findings")))
    return df.drop("row_findings", "url_findings", "attachment_findings", "name_points")


def findings_union(messages: DataFrame, redirect_summary: DataFrame | None = None, attachments: DataFrame | None = None) -> DataFrame:
    """Bag of the findings of all analyzers: message_id, source, finding. The sources that look at the message alone come
    from one pass over it; URLs and payloads add rows of their own."""
    p = gateway_profile(messages)
    named = lambda findings: F.transform(findings, lambda f: f["finding"])
    own = {"auth": named(H.auth_findings()), "sender": named("sender_findings"), "routing": named("routing_findings"), "integrity": named("integrity_findings"),
           "content": F.col("content_labels"), "attachment": F.col("attachment_findings")}
    p = stored(p.select("message_id", *[c.alias(k) for k, c in own.items()]), "findings")  # the analyzers run once
    rows = p.select("message_id", F.explode(F.array(*[F.struct(F.lit(k).alias("source"), F.col(k).alias("findings")) for k in own])).alias("f"))
    rows = rows.select("message_id", "f.source", F.explode("f.findings").alias("finding"))
    urls = messages.select("message_id", gateway_urls(F.col("text_body"), F.col("html_body")).alias("_urls"))
    # an inner explode would be given a filter on its array, which the optimizer copies through all steps of the score
    urls = url_findings(urls, redirect_summary).select("message_id", F.lit("url").alias("source"), F.explode_outer("url_texts").alias("finding"))
    rows = rows.unionByName(urls.where(F.col("finding").isNotNull()))
    if attachments is not None:  # payloads of messages that are there
        mine = attachments.join(messages.select("message_id"), "message_id", "left_semi")
        rows = rows.unionByName(mine.select("message_id", F.lit("attachment").alias("source"), F.explode("link_findings").alias("finding")))
    return rows


def upload_scores(messages: DataFrame, attached: DataFrame | None = None) -> DataFrame:
    """Upload profile: one row per row of ``messages`` with score, verdict, ordered categories.

    ``attached`` (message_id, pdf_parts, links array) comes from ``attached_links``."""
    text_batches(messages.sparkSession)
    df = H.header_profile(messages)
    if attached is not None:
        # both sides of the join are plain, so that Spark can split a common id
        df = df.join(stored(attached, "attached-links"), "message_id", "left")
    links = F.coalesce(F.col("links"), F.array().cast("array<string>")) if attached is not None else F.array().cast("array<string>")
    pdf_parts = F.coalesce(F.col("pdf_parts"), F.lit(0)) if attached is not None else F.lit(0)
    body = F.when(TX.blank("text_body") != "", F.col("text_body")).otherwise(TX.blank("html_body"))
    df = df.withColumns({"body": body, "attachments": names_array(), "_links": links, "_pdfs": pdf_parts})
    df = df.withColumn("_norm", F.trim(F.concat(TX.matching_text(F.col("subject")), F.lit(" "), TX.matching_text(F.col("body")))))
    df = df.withColumn("_ids", TX.keyword_ids(F.col("_norm")))
    execs = F.size(F.filter("attachments", lambda n: files.ends_with_any(n, R.UPLOAD_EXECUTABLES)))
    status = lambda p: F.col(f"auth.{p}.status").isin("FAIL", "PERMERROR")
    spoofs = F.size(F.filter("sender_findings", lambda f: f["finding"].isin("Display Name Email Spoofing", "Free Email Brand Impersonation")))
    df = df.withColumns({
        "reply_points": F.when(F.col("reply_mismatch"), 25).otherwise(0), "keyword_points": TX.keyword_score(F.col("_ids")),
        "_kc": TX.categories_hit(F.col("_ids")), "exec_points": execs * 35, "pdf_points": F.col("_pdfs") * 20,
        "auth_points": F.when(status("spf"), 25).otherwise(0) + F.when(status("dkim"), 25).otherwise(0) + F.when(status("dmarc"), 30).otherwise(0),
        "spoof_points": spoofs * 25})
    facts = ["reply_points", "keyword_points", "_kc", "exec_points", "pdf_points", "auth_points", "spoof_points", "header_security_score", "from_addr", "subject"]
    df = df.select("message_id", F.monotonically_increasing_id().alias("_row"), F.struct(*facts).alias("m"), "_links", upload_urls(F.col("body"), F.col("_links")).alias("_urls"))
    df = df.select("message_id", "_row", "m", "_links", F.posexplode_outer("_urls").alias("pos", "url"))
    df = U.assess(df)
    bad = (F.size("reasons") > 0) | F.coalesce(F.array_contains("_links", F.col("url")), F.lit(False))
    df = df.groupBy("_row", "message_id").agg(F.first("m").alias("m"), F.count("url").alias("urls"), F.sum(F.when(bad & F.col("url").isNotNull(), 1).otherwise(0)).alias("bad_urls"))
    df = df.select("message_id", "m.*", "urls", "bad_urls").withColumn("url_points", F.col("bad_urls") * 25)
    cat = lambda cond, name: F.when(cond, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    total = sum((F.col(c) for c in ("keyword_points", "exec_points", "pdf_points", "url_points", "auth_points", "spoof_points")), F.col("reply_points"))
    df = df.withColumns({
        "risk_score": F.least(F.lit(100), total).cast("int"),
        "categories": F.array_distinct(F.concat(
            cat(F.col("reply_points") > 0, "Header anomaly"), F.col("_kc"), cat(F.col("exec_points") > 0, "Executable attachments"),
            cat(F.col("pdf_points") > 0, "Link hidden in attachment"), cat(F.col("bad_urls") > 0, "Suspicious URL"),
            cat(F.col("auth_points") > 0, "Authentication failure"), cat(F.col("spoof_points") > 0, "Header anomaly")))}).drop("_kc")
    return df.withColumn("verdict", bands.verdict(F.col("risk_score")))


def attached_links(links: DataFrame) -> DataFrame:
    """Per message: number of PDF parts with links and the distinct links of PDFs and images. A message
    holds at most 20 parts, so the set stays small; ``links`` is the result of ``attachment_links``."""
    each = links.select("message_id", (F.size("pdf_urls") > 0).cast("int").alias("pdf"), F.concat("pdf_urls", "qr_urls").alias("u"))
    return each.groupBy("message_id").agg(F.sum("pdf").cast("int").alias("pdf_parts"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("u")))).alias("links"))


def url_origins(messages: DataFrame, attached: DataFrame) -> DataFrame:
    """URL table of a mail with the flag whether the URL also sits in an attachment (existence join)."""
    body = F.when(TX.blank("text_body") != "", F.col("text_body")).otherwise(TX.blank("html_body"))
    urls = messages.select("message_id", F.explode(upload_urls(body)).alias("url")).withColumn("in_body", F.lit(True))
    inside = attached.select("message_id", F.explode("links").alias("url")).withColumn("in_attachment", F.lit(True))
    both = urls.join(inside, ["message_id", "url"], "full")
    return both.select("message_id", "url", F.when(F.col("in_attachment"), "PDF attachment").otherwise("message body").alias("origin"),
                       F.coalesce("in_body", F.lit(False)).alias("in_body"))
