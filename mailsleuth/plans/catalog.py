"""Every operator as a query over the test tables. Each entry reads whole tables through ``Views``."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import bands, dates, files, header as H, ip as IP, rules as R, text as TX, url as U
from ..operators import analyst, correlation, enforcement, enrichment, indicators, ingest, postdelivery, redirects, routing, scoring, skew, urls
from ..sources import mail_files, tables
from ..sources.gram_index import GramIndex
from ..sources.keyed_table import KeyedTable
from ..operators.components import PARENT_ROW
from ..session import new_folder, stored
from ..streaming import jobs
from .fixtures import VIEWS, Views

QUERIES: dict[str, Callable[[Views], DataFrame]] = {}


def query(fn: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def joined(c, sep: str = "|") -> Column:
    return F.array_join(c, sep)


def big(*names: str) -> list[Column]:
    return [F.col(n).cast("bigint").alias(n) for n in names]


# ---- sources and ingest --------------------------------------------------------------------

def raw_mail(v: Views) -> DataFrame:
    """Whole MIME messages of the mail view: text part, HTML part where there is one, named attachments."""
    m = v.messages
    nl, mark = F.lit("\n"), F.lit("--=_part_7f3a\n")
    part = lambda head, body: F.concat(mark, F.lit(head), nl, body, nl)
    atts = F.array_join(F.transform(scoring.names_array(), lambda n: F.concat(
        mark, F.lit('Content-Type: application/octet-stream\nContent-Disposition: attachment; filename="'), n, F.lit('"\nContent-Transfer-Encoding: base64\n\n'),
        F.base64(F.concat(F.lit("bytes of "), n).cast("binary")), nl)), "")
    raw = F.concat(F.replace("raw_headers", F.lit("\r\n"), nl), F.lit('MIME-Version: 1.0\nContent-Type: multipart/mixed; boundary="=_part_7f3a"\n\n'),
                   part("Content-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n", F.col("text_body")),
                   F.when(F.col("html_body") != "", part("Content-Type: text/html; charset=utf-8\nContent-Transfer-Encoding: 8bit\n", F.col("html_body"))).otherwise(""),
                   atts, F.lit("--=_part_7f3a--\n"))
    return m.select("message_id", "received_at", raw.cast("binary").alias("content"))


@query
def s01_mail_listing(v):
    landed = v.messages.select(
        F.concat(F.lit("landing/"), F.col("message_id"), F.when(F.col("doc_id") % 10 == 0, ".txt").when(F.col("doc_id") % 10 == 1, ".EML").otherwise(".eml")).alias("path"),
        F.col("received_at").alias("modificationTime"), F.octet_length("text_body").alias("length"), F.lit(None).cast("binary").alias("content"))
    return mail_files.list_mail(landed).select("file_name", *big("length"))


@query
def s02_header_table(v):
    return ingest.header_table(v.messages).select("message_id", *big("pos"), "name", "value")


@query
def s02_header_map(v):
    m = v.messages.withColumn("m", ingest.header_map(H.header_fields(F.col("raw_headers"))))
    return m.select("message_id", F.size("m").cast("bigint").alias("names"), joined(F.coalesce(F.try_element_at("m", F.lit("subject")), F.array().cast("array<string>"))).alias("subjects"),
                    joined(F.coalesce(F.try_element_at("m", F.lit("received")), F.array().cast("array<string>"))).alias("received"),
                    ingest.effective_message_id(H.first(H.header_fields(F.col("raw_headers")), "Message-ID"), F.concat(F.lit("fallback-"), F.col("message_id"))).alias("effective_id"))


@query
def s03_mime_bodies(v):
    d = mail_files.decode_mime(raw_mail(v))
    return d.select("message_id", F.md5(F.encode("text_body", "UTF-8")).alias("text_md5"), "html_body", "has_plain_text", "has_html", F.size("attachments").cast("bigint").alias("attachments"),
                    joined(F.transform("attachments", lambda a: F.concat(a["original_filename"], F.lit("="), F.decode(a["content"], "UTF-8")))).alias("payloads"))


@query
def s04_recipients(v):
    return ingest.recipient_table(v.messages).select("message_id", "kind", *big("pos"), "address")


@query
def s05_attachment_catalogue(v):
    return ingest.attachment_catalogue(v.attachment_payloads.withColumnRenamed("payload", "content")).select("message_id", "sha256", *big("pos", "size_bytes"), "mime_type", "original_filename", "filename")


@query
def s07_backfill_scans(v):
    stored = v.scans.where(F.col("verdict") == "High Risk")
    out = analyst.backfill_scans(v.legacy_scans, stored)
    return out.select("id", "user_id", "subject", *big("risk_score"), "verdict", joined("categories").alias("categories"), "scan_epoch")


@query
def s07_backfill_counts(v):
    users = analyst.backfill_users(v.users.withColumn("role", F.when(F.col("user_id") % 11 == 0, "root").otherwise(F.col("role"))), v.users.where(F.col("role") == "admin"))
    scans = analyst.backfill_scans(v.legacy_scans, v.scans.where(F.col("verdict") == "High Risk"))
    count = lambda df, name, extra: df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("copied"), F.count_if(extra).alias("fixed"))
    return count(users, "users", F.col("role") == "user").unionByName(count(scans, "scans", F.size("categories") > 0))


@query
def s08_schema_evolution(v):
    old = v.scans.where(F.col("scan_id") % 2 == 0).select("scan_id", "risk_score")
    new = v.scans.where(F.col("scan_id") % 2 == 1).select("scan_id", "risk_score", "verdict", F.col("reply_to").alias("reply_to"))
    both = old.unionByName(new, allowMissingColumns=True)
    return analyst.evolve(both, {"verdict": ("string", "Low Risk"), "reply_to": ("string", ""), "status": ("string", "NEW"), "retry_count": ("bigint", 0)})


@query
def s09_history_csv(v):
    return analyst.history_export(v.scans, v.users)


@query
def s10_report_json(v):
    return analyst.report_json(v.scans)


@query
def s11_network_ranges(v):
    nets = v.base("supplier").select(F.concat(F.lit("10."), (F.col("s_suppkey") % 256).cast("string"), F.lit("."), (F.col("s_suppkey") * 7 % 256).cast("string"), F.lit(".9/"), (8 + F.col("s_suppkey") % 25).cast("string")).alias("network"), "s_suppkey")
    return tables.with_range(nets).select("s_suppkey", "network", "start_ip", "end_ip")


@query
def s12_detection_rules(v):
    return correlation.detection_rules(v.scans.where(F.col("risk_score") >= 50))


# ---- projections and filters ---------------------------------------------------------------

@query
def p01_visible_scans(v):
    return analyst.visible(v.scans, 7).select("scan_id", "user_id", "verdict")


@query
def p02_history_search(v):
    return analyst.search_history(v.scans, v.users, "PayPal-help", user_id=7).select("scan_id", "sender", "submitted_by", "verdict")


@query
def p02_history_search_public(v):
    return analyst.search_history(v.scans, v.users, "guest", verdict="High Risk").select("scan_id", "sender", "submitted_by", "verdict")


@query
def p02_history_search_number(v):
    return analyst.search_history(v.scans, v.users, "14").select("scan_id", "subject", "submitted_by")


@query
def p02_index_search(v):
    """The history search by a kept index, after half of the scans are in it and after the rest was appended."""
    index, out = GramIndex(v.spark, new_folder(v.spark, "history-index"), 8), []
    for step in (0, 1):
        known = v.scans.where(F.col("scan_id") % 2 <= step)
        index.append(analyst.history_text(v.scans.where(F.col("scan_id") % 2 == step), v.users), step)
        for term, user in (("PayPal-help", 7), ("14", None), ("r1", 11), ("guest", None)):
            found = analyst.search_history(known, v.users, term, user_id=user, index=index)
            # written before the next append: one plan must not read a table as it is at two times
            out.append(stored(found.select(F.lit(step).cast("bigint").alias("step"), F.lit(term).alias("term"), "scan_id", "submitted_by"), "found"))
    return functools.reduce(DataFrame.unionByName, out)


@query
def p03_category_filter(v):
    return analyst.search_history(v.scans, v.users, category="Suspicious URL", user_id=11).select("scan_id", "categories_text")


@query
def p04_category_facets(v):
    return analyst.category_facets(v.scans, 7)


@query
def p05_user_search(v):
    return analyst.search_users(v.users, "#0000", "analyst").select("user_id", "username", "email", "role")


def decided(v: Views) -> DataFrame:
    return enforcement.decide(v.enforceable.withColumn("findings", analyst.list_of("findings_text")))


def quarantined(v: Views) -> DataFrame:
    return enforcement.quarantine_rows(decided(v))


@query
def p06_quarantine_list(v):
    return analyst.quarantine_list(quarantined(v), "t3", "QUARANTINED").select("quarantine_id", "message_id", "original_sender", "recipient", *big("risk_score"))


@query
def p06_review_list(v):
    return decided(v).where((F.col("final_status") == "REVIEW") & (F.col("tenant_id") == "t1")).select("message_id", "from_addr", *big("risk_score"))


def search_words(v: Views) -> DataFrame:
    """Terms to search for: all addresses, cities, hashes, and some words."""
    return v.ips.where(F.coalesce("ip", F.lit("")) != "").select(F.col("ip").alias("term")).union(
        v.networks.select(F.lower("city"))).union(v.base("nation").select(F.md5(F.col("n_name").cast("binary")))).union(
        v.base("region").select(F.element_at(F.array(*[F.lit(t) for t in ("malicious.xyz", "bulk7.example.net", "ORDER NOTE 5", "10.0.0.1", "m")]), (F.col("r_regionkey") % 5 + 1).cast("int"))))


def searched(out: DataFrame) -> DataFrame:
    return out.select("term", "ioc_type", "is_private_ip", "md5", "sha1", "sha256", "domain_entropy", *big("matches_count"), F.coalesce(joined("scan_ids"), F.lit("")).alias("scan_ids"), *big("reputation_score"), "verdict")


@query
def p07_indicator_search(v):
    return searched(indicators.search_terms(search_words(v), v.scans, limit=10))


@query
def p07_index_search(v):
    """The same by a kept index that took the scans in three batches."""
    index = GramIndex(v.spark, new_folder(v.spark, "scan-index"), 8)
    for n in range(3):
        index.append(v.scans.where(F.col("scan_id") % 3 == n).select(F.col("scan_id").alias("id"), indicators.scan_text().alias("text")), n)
    return searched(indicators.search_terms(search_words(v), v.scans, limit=10, index=index))


@query
def p08_fetch_safety(v):
    df = U.with_fetch_reason(U.url_parts(v.urls.select("url").distinct()))
    return df.select("url", "hostname", "fetch_reason", "fetch_allowed")


@query
def p09_envelope_gate(v):
    m = H.with_headers(v.messages)
    each = m.select("message_id", F.explode(F.array(H.addr_spec(F.col("from_hdr")), F.col("return_path"), F.col("from_hdr"), F.lit("<>"))).alias("address"))
    return ingest.envelope_gate(each, "address").select("message_id", "address", "accepted")


@query
def p10_message_gate(v):
    m = v.messages.withColumn("size_bytes", F.octet_length("text_body").cast("bigint") * F.when(F.col("doc_id") % 20 == 0, 0).when(F.col("doc_id") % 20 == 1, 100000).otherwise(1))
    return ingest.message_gate(m, F.col("size_bytes")).select("message_id", *big("size_bytes"), "gate")


@query
def p11_threshold_action(v):
    return v.scans.select("scan_id", "risk_score", postdelivery.action(F.col("risk_score")).alias("action_taken"), postdelivery.action(F.col("risk_score"), 40, "LABEL").alias("label_action"))


# ---- joins ---------------------------------------------------------------------------------

@query
def j01_scans_users(v):
    return analyst.with_submitter(v.scans, v.users).select("scan_id", "user_id", "submitted_by", "email")


@query
def j02_insert_if_absent(v):
    stored = v.scans.where(F.col("scan_id") % 3 == 0)
    return indicators.unseen(v.scans.select("subject", "sender"), stored, ["subject", "sender"])


@query
def j03_upsert_decisions(v):
    base = decided(v).select("message_id", "decision", F.col("risk_score"), "decided_at")
    again = v.release_requests.where(F.col("action") == "REJECT").select("message_id", F.lit("REJECT").alias("decision"), F.lit(100).cast("bigint").alias("risk_score"), F.col("requested_at").alias("decided_at"))
    again = skew.latest(again, ["message_id"], F.col("decided_at"))
    return enforcement.upsert_decisions(base, again).select("message_id", "decision", "risk_score")


@query
def j03_upsert_store(v):
    """The decisions as a kept table that takes the rejects in five batches, with buckets rewritten on the way."""
    row = "message_id string, decision string, risk_score long, decided_at timestamp_ntz, again int"
    table = KeyedTable(v.spark, new_folder(v.spark, "decisions"), row, ["message_id"], ["decided_at", "again"], buckets=8, max_deltas=2)
    at = F.col("decided_at").cast("timestamp_ntz")
    table.upsert(decided(v).select("message_id", "decision", F.col("risk_score").cast("long"), at.alias("decided_at"), F.lit(0).alias("again")), 0)
    rejects = v.release_requests.where(F.col("action") == "REJECT").select("request_id", "message_id", F.lit("REJECT").alias("decision"), F.lit(100).cast("long").alias("risk_score"), F.col("requested_at").cast("timestamp_ntz").alias("decided_at"), F.lit(1).alias("again"))
    for n in range(5):
        table.upsert(rejects.where(F.col("request_id") % 5 == n), n + 1)
    return table.read().select("message_id", "decision", "risk_score")


@query
def j04_status_store(v):
    """The queue as a kept table, to which the message states come in three batches."""
    table = KeyedTable(v.spark, new_folder(v.spark, "queue"), "message_id string, status string, step int", ["message_id"], ["step"], buckets=8, max_deltas=2)
    table.upsert(v.base("orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("message_id"), F.lit("PROCESSING").alias("status"), F.lit(0).alias("step")), 0)
    states = decided(v).select("message_id", F.col("final_status").alias("status"), F.lit(1).alias("step"))
    for n in range(3):
        table.upsert(states.where(F.pmod(F.hash("message_id"), F.lit(3)) == n), n + 1)
    return table.read().select("message_id", "status")


@query
def st5_release_store(v):
    """Release requests in four batches, one after the other, against the kept quarantine records."""
    table = KeyedTable(v.spark, new_folder(v.spark, "quarantine"), enforcement.QUARANTINE_ROW, ["message_id", "tenant_id"], ["changed_by"], buckets=8, max_deltas=2, bucket_by=["message_id"])
    table.upsert(quarantined(v).select("message_id", "tenant_id", "quarantine_id", "status", F.lit(0).cast("long").alias("changed_by")), 0)
    asked = v.release_requests.where(F.col("action") == "RELEASE")
    messages = v.enforceable.where(~F.col("message_id").endswith("77"))
    last, results = asked.agg(F.max("request_id")).first()[0] or 0, []
    for n in range(4):
        part = asked.where((F.col("request_id") * 4 > last * n) & (F.col("request_id") * 4 <= last * (n + 1)) | (F.lit(n == 0) & (F.col("request_id") <= 0)))
        results.append(enforcement.release_batch(table, part, messages, n + 1))
    return functools.reduce(DataFrame.unionByName, results).select("request_id", "message_id", "quarantine_id", "result")


@query
def j04_status_propagation(v):
    jobs = v.base("orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("message_id"), F.lit("PROCESSING").alias("status"))
    return enforcement.propagate_status(jobs, decided(v))


@query
def j05_network_lookup(v):
    df = enrichment.enrich(v.ips, v.networks)
    return df.select("event_id", "clean_ip", "address_type", *big("ip_version"), "country", "country_code", "region", "city", "latitude", "longitude", "timezone", "asn", "organization", "network", "build_date", "source", "status", "provider_used")


def attached(v: Views) -> DataFrame:
    return scoring.attached_links(ingest.attachment_links(v.attachment_payloads.withColumnRenamed("payload", "content")))


def payload_bodies(v: Views) -> DataFrame:
    """All payloads of a message but PDFs and images, in order, as its body."""
    p = v.attachment_payloads
    text = p.where(~((F.col("mime_type") == "application/pdf") | F.lower("original_filename").endswith(".pdf") | files.is_image(F.col("original_filename"), F.col("mime_type"))))
    each = F.array_sort(F.collect_list(F.struct("pos", "payload")))
    return text.groupBy("message_id").agg(F.array_join(F.transform(each, lambda x: x["payload"]), "\n").alias("text_body")).withColumn("html_body", F.lit(""))


@query
def j06_url_origin(v):
    bodies = payload_bodies(v)
    return scoring.url_origins(bodies, attached(v)).select("message_id", "url", "origin", "in_body")


def scan_iocs(v: Views) -> DataFrame:
    """Indicators of the scans in long form: listed ones, sender domains."""
    kind = lambda c: F.when(c.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip").otherwise("domain")
    listed = v.scans.select("scan_id", F.explode(analyst.list_of("iocs_text")).alias("ioc_value"))
    own = v.scans.select("scan_id", F.lower(F.substring_index("sender", "@", -1)).alias("ioc_value"))
    return listed.unionByName(own).withColumn("ioc_type", kind(F.col("ioc_value")))


@query
def j07_reputation(v):
    out = indicators.reputation(scan_iocs(v), v.reputation, F.expr("timestamp_ntz'2024-01-01 12:00:00'"))
    return out.withColumn("confidence", F.round("confidence", 6))


@query
def j08_score_back(v):
    out = urls.score_back(v.urls, urls.url_scores(v.urls, redirects.redirect_risk_by_url(v.redirect_hops)))
    return out.select("message_id", *big("pos"), "url", *big("url_risk_score"), "risk_level")


@query
def j09_release_results(v):
    reqs = v.release_requests.where(F.col("action") == "RELEASE")
    msgs = v.enforceable.where(~F.col("message_id").endswith("77"))
    return enforcement.release_results(reqs, quarantined(v), msgs).select("request_id", "message_id", "quarantine_id", "result")


# ---- aggregations and scores ---------------------------------------------------------------

@query
def a01_admin_counters(v):
    d = decided(v)
    return analyst.admin_counters(v.users, v.scans, d, enforcement.quarantine_rows(d), v.enforceable)


@query
def a02_analyst_counters(v):
    return analyst.analyst_counters(v.scans)


def batch_files(spark: SparkSession) -> int:
    """Files in which a micro-batch lands: one for every core, as a file written or read by itself is one task."""
    return max(1, spark.sparkContext.defaultParallelism)


@query
def a02_live_counters(v):
    """The same as a stream: every tenth scan lands with a wrong score first and is corrected in a later file."""
    spark, out = v.spark, new_folder(v.spark, "counters")
    rows = v.scans.select(F.col("scan_id").cast("long").alias("scan_id"), F.col("user_id").cast("long").alias("user_id"), "verdict", F.col("risk_score").cast("long").alias("risk_score"))
    wrong = rows.where(F.col("scan_id") % 10 == 0).withColumns({"verdict": F.lit("Low Risk"), "risk_score": F.lit(0).cast("long")})
    first = rows.where(F.col("scan_id") % 10 != 0)
    for part in (jobs.signed(first.where(F.col("scan_id") % 2 == 0).unionByName(wrong)), jobs.signed(first.where(F.col("scan_id") % 2 == 1)), jobs.signed(rows.where(F.col("scan_id") % 10 == 0), wrong)):
        part.repartition(batch_files(spark)).write.mode("append").parquet(f"{out}/landed")
    landed = spark.readStream.schema(jobs.signed(rows).schema).option("maxFilesPerTrigger", batch_files(spark)).parquet(f"{out}/landed")
    table = KeyedTable(spark, f"{out}/counters", analyst.ANALYST_ROW, ["user_id"], ["step"], buckets=8)
    jobs.run_counters(landed.where(F.col("user_id").isNotNull()), ["user_id"], analyst.analyst_sums(), table, f"{out}/checkpoint").awaitTermination()
    return analyst.live_analyst_counters(table.read())


def event_hops(v: Views) -> DataFrame:
    h = v.hops.withColumn("from_ip", TX.blank("from_ip"))
    return routing.hop_delays(routing.classify_hops(h.select("message_id", "seq", "from_host", "from_ip", "hop_epoch")))


@query
def a03_delivery_summary(v):
    out = routing.delivery_summary(event_hops(v))
    return out.select("message_id", *big("total_hops", "internal_hops", "external_hops"), "max_delay", F.round("avg_delay", 4).alias("avg_delay"), "max_delay_display", "first_received_raw", "final_delivery_raw", "total_delivery_time")


@query
def a04_routing_totals(v):
    return routing.routing_totals(v.messages).select("message_id", *big("hop_count", "total_transit_seconds", "private_relay_count", "timing_issues", "infrastructure_trust_score"))


def upload_text(v: Views) -> DataFrame:
    m = H.with_headers(v.messages)
    body = F.when(TX.blank("text_body") != "", F.col("text_body")).otherwise(TX.blank("html_body"))
    return m.select("message_id", "subject", "text_body", "html_body", F.trim(F.concat(TX.matching_text(F.col("subject")), F.lit(" "), TX.matching_text(body))).alias("norm"))


@query
def a05_keyword_score(v):
    t = upload_text(v).select("message_id", TX.keyword_ids(F.col("norm")).alias("ids"))
    return t.select("message_id", TX.keyword_score(F.col("ids")).cast("bigint").alias("keyword_score"), joined(TX.categories_hit(F.col("ids"))).alias("categories"))


@query
def a06_lure_score(v):
    m = H.with_headers(v.messages)
    df = scoring.text_lures(m, F.concat(F.col("subject"), F.lit(" "), TX.blank("text_body")))
    return df.select("message_id", *[F.col("lure_points")[k].cast("bigint").alias(k) for k, *_ in R.LURES], *big("lure_score"), "lure_level", joined("lure_tactics").alias("tactics"))


@query
def a07_url_risk(v):
    s = urls.url_scores(v.urls, redirects.redirect_risk_by_url(v.redirect_hops))
    return s.select("url", *big("occurrences", "url_risk_score"), "risk_level", joined("url_findings").alias("findings"))


@query
def a07_host_rollup(v):
    return urls.host_rollup(urls.url_scores(v.urls))


@query
def a08_message_url_penalty(v):
    return urls.message_url_penalty(urls.score_back(v.urls, urls.url_scores(v.urls))).select("message_id", *big("url_penalty", "urls_scored"))


def attachment_facts(v: Views) -> DataFrame:
    return ingest.attachment_facts(v.attachment_payloads.withColumnRenamed("payload", "content"))


@query
def a09_attachment_penalty(v):
    m = v.messages.select("message_id", files.named_parts(scoring.names_array()).alias("parts"))
    m = m.select("message_id", ingest.attachment_points(F.col("parts")).alias("points"), scoring.attachment_texts(F.col("parts")).alias("texts"))
    m = skew.attach_unique(m, attachment_facts(v), ["message_id"], skew.hot_keys(v.messages, ["message_id"]))
    return m.select("message_id", ingest.attachment_penalty(F.col("points"), F.col("pdf_links"), F.col("image_links")).cast("bigint").alias("attachment_penalty"),
                    joined(F.concat("texts", F.coalesce("link_findings", F.array().cast("array<string>")))).alias("findings"))


def profile(v: Views) -> DataFrame:
    return scoring.gateway_profile(v.messages)


@query
def a10_header_penalty(v):
    return profile(v).select("message_id", *big("header_penalty"))


@query
def a11_auth_penalty(v):
    return profile(v).select("message_id", "spf", "dkim", "dmarc", *big("auth_penalty"))


@query
def a12_sender_penalty(v):
    return profile(v).select("message_id", "g_from_domain", "g_display_name", "g_homograph", "g_name_brand", "g_reply_mismatch", "g_tld", *big("sender_penalty"))


@query
def a13_content_penalty(v):
    return profile(v).select("message_id", *big("lure_score"), joined("content_labels").alias("labels"), *big("content_penalty"))


@query
def a13_content_penalty_full(v):
    return scoring.gateway_profile(v.messages, "full").select("message_id", *big("lure_score", "content_penalty"))


@query
def a14_gateway_score(v):
    s = scoring.gateway_scores(v.messages, redirects.redirect_risk_by_url(v.redirect_hops), attachments=attachment_facts(v))
    return s.select("message_id", *big(*scoring.PENALTIES, "risk_score"), "severity", "recommendation", "decision", F.size("findings").cast("bigint").alias("findings"), joined("findings").alias("top_findings"))


@query
def a15_upload_score(v):
    s = scoring.upload_scores(v.messages)
    return s.select("message_id", *big("reply_points", "keyword_points", "exec_points", "url_points", "auth_points", "spoof_points", "risk_score"), "verdict", joined("categories").alias("categories"))


@query
def a15_upload_score_attachments(v):
    s = scoring.upload_scores(v.messages, attached(v))
    return s.select("message_id", *big("pdf_points", "url_points", "risk_score"), "verdict")


@query
def a16_header_score(v):
    p = H.header_profile(v.messages)
    return p.select("message_id", *big("auth_score", "sender_trust_score", "infrastructure_trust_score", "integrity_score", "header_security_score"), "header_verdict", joined(F.transform("header_findings", lambda f: f["finding"])).alias("findings"))


@query
def a17_url_verdict(v):
    df = urls.url_verdicts(v.urls.select("url").distinct(), redirects.chain_facts_by_url(v.redirect_hops))
    return df.select("url", "rule_ip", "rule_brand", "rule_tld", "rule_entropy", "rule_redirect", "secure_scheme", *big("suspicious_rules"), "verdict", *big("risk_score"))


def indicator_rows(v: Views) -> DataFrame:
    m = v.messages
    text = F.concat(F.col("raw_headers"), F.lit("\n"), TX.blank("text_body"), F.lit("\n"), TX.blank("html_body"))
    return indicators.with_indicators(m, text, ingest.gateway_urls(F.col("text_body"), F.col("html_body")))


@query
def a18_indicator_sets(v):
    return indicators.with_hashes(indicator_rows(v), attachment_facts(v)).select("message_id", *[joined(c).alias(c) for _, c in indicators.KINDS])


@query
def a18_indicator_sightings(v):
    return indicators.sightings(indicators.indicator_table(indicators.with_hashes(indicator_rows(v), attachment_facts(v))))


def mailboxes(v: Views) -> DataFrame:
    return v.messages.withColumn("user_email", F.concat(F.lit("user"), (F.col("doc_id") % 7).cast("string"), F.lit("@corp.example.com")))


@query
def a19_rescan_totals(v):
    return postdelivery.rescan_totals(postdelivery.rescan(mailboxes(v)))


@query
def a20_graph_summary(v):
    return correlation.graph_summary(v.scans)


# ---- windows -------------------------------------------------------------------------------

@query
def w01_hop_numbers(v):
    return event_hops(v).select("message_id", "seq", "hop_no")


@query
def w02_hop_delays(v):
    return event_hops(v).select("message_id", "seq", "delay_seconds", "delay_display", joined("observations").alias("observations"))


@query
def w03_duplicate_relays(v):
    return event_hops(v).select("message_id", "seq", "is_duplicate")


@query
def w04_known_delays(v):
    return event_hops(v).select("message_id", "seq", "known_delay", "timing_finding")


@query
def w05_redirect_chains(v):
    return redirects.chain_risk(v.redirect_hops).select("chain_id", "original_url", "final_url", *big("total_hops"), "has_loop", "url_loop", "has_cross_domain", "has_upgrade", "has_downgrade", "has_shortener", "has_ip_destination", "has_risky_tld", "brand", *big("risk_score"))


@query
def w06_redirect_chains_by_source(v):
    return redirects.chain_risk_by_source(v.redirect_hops).select("chain_id", *big("redirect_count"), "has_loop", *big("cross_domain_count", "https_downgrades"), "original_url", *big("risk_score"))


@query
def w07_ordered_distinct(v):
    return v.messages.select("message_id", joined(F.array_distinct(F.split(F.lower("text_body"), r"[^a-z]+"))).alias("words")).select("message_id", F.md5(F.col("words").cast("binary")).alias("words_md5"))


@query
def w08_first_rule_wins(v):
    m = H.with_headers(v.messages)
    return m.select("message_id", H.mail_client(F.col("fields")).alias("client"), U.suffix_match(F.lower(F.substring_index("from_hdr", "@", -1)), R.GATEWAY_TLDS).alias("tld"))


@query
def w09_first_seen_nodes(v):
    return correlation.graph_nodes(v.scans).select("node_id", "label", "risk")


# ---- sorts, limits, sets -------------------------------------------------------------------

@query
def t01_history_newest(v):
    return analyst.search_history(v.scans, v.users, user_id=3).select("scan_id", "scan_time")


@query
def t02_recent_scans(v):
    return analyst.newest(v.scans, 10, F.col("scan_time").desc(), F.col("scan_id").desc()).select("scan_id", "verdict", "risk_score")


@query
def t03_work_batch(v):
    jobs = v.attempts.groupBy("message_id").agg(F.min("attempted_at").alias("received_at"), F.count_if(F.col("outcome") == "ok").alias("ok"))
    jobs = jobs.withColumn("status", F.when(F.col("ok") == 0, "QUEUED").when(F.col("ok") == 1, "RECEIVED").otherwise("DELIVERED"))
    return analyst.work_batch(jobs, 10).select("message_id", "status")


@query
def t04_severity_ranking(v):
    p = H.header_profile(v.messages)
    return p.select("message_id", F.posexplode_outer("header_findings").alias("rank", "f")).where(F.col("f").isNotNull()).select("message_id", *big("rank"), F.col("f.finding").alias("finding"), F.col("f.severity").alias("severity"))


@query
def t05_first_urls(v):
    from pyspark.sql import Window
    w = Window.partitionBy("message_id").orderBy("pos")
    return v.urls.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= R.MAX_SCORED_URLS).select("message_id", *big("pos"), "url")


@query
def t06_capped_graph(v):
    nodes, edges = correlation.capped_graph(v.scans, max_scans=50, max_nodes=200)
    return edges.groupBy("label").agg(F.count(F.lit(1)).alias("edges")).withColumn("kind", F.lit("edge")).unionByName(
        nodes.groupBy(F.col("node_group").alias("label")).agg(F.count(F.lit(1)).alias("edges")).withColumn("kind", F.lit("node")))


@query
def u01_url_union(v):
    bodies = payload_bodies(v).join(attached(v), "message_id", "full")
    return bodies.select("message_id", F.posexplode(ingest.upload_urls(F.col("text_body"), F.col("links"))).alias("pos", "url")).select("message_id", *big("pos"), "url")


@query
def u02_findings_union(v):
    return scoring.findings_union(v.messages, redirects.redirect_risk_by_url(v.redirect_hops), attachment_facts(v)).groupBy("source", "finding").agg(F.count(F.lit(1)).alias("messages"))


@query
def u03_blocklist_difference(v):
    return correlation.scan_blocklist(v.scans).select("scan_id", joined("domains").alias("domains"), joined("ips").alias("ips"), joined("urls").alias("urls"))


@query
def u04_graph_edges(v):
    return correlation.graph_edges(v.scans)


# ---- scalar work inside jobs ---------------------------------------------------------------

@query
def f01_matching_text(v):
    return v.base("documents").select("doc_id", TX.matching_text(F.col("text")).alias("norm")).select("doc_id", F.md5(F.col("norm").cast("binary")).alias("norm_md5"), F.length("norm").cast("bigint").alias("chars"))


@query
def f02_content_text(v):
    return v.messages.select("message_id", TX.content_text(F.concat(F.col("text_body"), F.lit("\n"), F.col("html_body"))).alias("t")).select(
        "message_id", F.length("t").cast("bigint").alias("chars"), F.md5(F.col("t").cast("binary")).alias("text_md5"))


@query
def f03_keyword_hits(v):
    t = upload_text(v).select("message_id", TX.keyword_ids(F.col("norm")).alias("ids")).select("message_id", F.explode(TX.category_matches(F.col("ids"))).alias("m"))
    return t.select("message_id", F.col("m.category").alias("category"), F.col("m.weight").cast("bigint").alias("weight"), joined("m.keywords").alias("keywords"))


@query
def f04_content_patterns(v):
    # an inner explode would be given a filter on its array, and the patterns would be searched for twice
    m = scoring.with_content_text(H.with_headers(v.messages)).select("message_id", TX.content_labels(F.col("_ct")).alias("labels"))
    return m.select("message_id", F.explode_outer("labels").alias("label")).where(F.col("label").isNotNull())


@query
def f05_lure_hits(v):
    d = v.base("documents").unionByName(v.messages.select(F.col("doc_id") + 10000000, F.col("text_body").alias("text")).toDF("doc_id", "text"), allowMissingColumns=True)
    d = d.select("doc_id", TX.phrase_ids(F.lower("text"), TX.LURE_TERMS).alias("ids"))
    return d.select("doc_id", *[n.cast("bigint").alias(k) for k, n in TX.lure_counts(F.col("ids")).items()])


@query
def f06_gateway_urls(v):
    return ingest.url_table(v.messages, ingest.gateway_urls(F.col("text_body"), F.col("html_body"))).select("message_id", *big("pos"), "url")


@query
def f06_page_urls(v):
    return ingest.url_table(v.base("pages").select(F.col("page_id").cast("string").alias("message_id"), "url", "html"), ingest.gateway_urls(F.concat(F.lit("see "), F.col("url")), F.concat(F.lit('<a href="'), F.col("url"), F.lit('&amp;z=1">x</a>'), F.col("html")))).select("message_id", *big("pos"), "url")


@query
def f07_indicator_matches(v):
    t = F.col("text")
    return v.base("documents").select("doc_id", joined(TX.extract_all(t, R.RE_IPV4)).alias("ipv4"), joined(TX.extract_all(t, R.RE_EMAIL)).alias("emails"), joined(TX.extract_all(t, R.RE_WALLET)).alias("wallets"), F.size(TX.extract_all(t, R.RE_IPV6)).cast("bigint").alias("ipv6"))


@query
def f08_url_parts(v):
    df = U.url_parts(v.urls.select("url").distinct())
    return df.select("url", "is_valid", "scheme", "hostname", *big("port"), "path", "params", "query", "fragment", "username", "password", *big("query_param_count"), "normalized_url", F.length("normalized_url").cast("bigint").alias("url_length"))


@query
def f09_numeric_hosts(v):
    hosts = v.ips.select("event_id", F.concat(F.lit("http://"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("0x"), F.lower(F.hex((F.col("event_id") * 2654435761) % 4294967296))))
        .when(F.col("event_id") % 3 == 1, ((F.col("event_id") * 2654435761) % 8589934592).cast("string"))
        .otherwise(F.concat(F.lit("0"), F.conv((F.col("event_id") % 300).cast("string"), 10, 8), F.lit(".1.2.3"))), F.lit("/")).alias("url"))
    return U.url_parts(hosts).select("event_id", "hostname", "decoded_ip", "numeric_ip_type")


@query
def f10_registered_domain(v):
    return U.url_parts(v.urls.select("url").distinct()).select("url", "evaluated_host", "root_domain", "subdomain")


@query
def f11_ip_classes(v):
    df = IP.with_ip_flags(v.ips.withColumn("c", IP.clean(F.col("ip"))), F.col("c"), "f")
    f = F.col("f")
    return df.select("event_id", "c", IP.timeline_class(f).alias("timeline_class"), IP.timeline_internal(f).alias("internal"), IP.hop_class(f, F.col("c")).alias("hop_class"), IP.hop_private(f).alias("hop_private"),
                     IP.geo_class(f).alias("geo_class"), IP.url_class(f).alias("url_class"), IP.restricted(f).alias("restricted"))


@query
def f12_entropy(v):
    df = U.url_parts(v.urls.select("url").distinct())
    e = lambda c: F.round(U.entropy(F.col(c)), 2)
    return df.select("url", e("hostname").alias("host_entropy"), e("path").alias("path_entropy"), e("normalized_url").alias("url_entropy"))


@query
def f13_query_payloads(v):
    df = U.url_parts(v.urls.select("url").distinct())
    return df.select("url", U.base64_payload(F.col("query")).alias("base64_payload"), joined(U.nested_urls(F.col("query"))).alias("nested_urls"))


@query
def f14_punycode_flag(v):
    hosts = U.url_parts(v.urls.select("url").distinct()).select("hostname").distinct()
    return hosts.select("hostname", U.is_punycode(F.col("hostname")).alias("is_punycode"))


@query
def f14_punycode_text(v):
    hosts = U.url_parts(v.urls.select("url").distinct()).select("hostname").distinct()
    return hosts.select("hostname", U.unicode_host(F.col("hostname")).alias("decoded"))


@query
def f15_lookalike_hosts(v):
    hosts = U.url_parts(v.urls.select("url").distinct()).select("hostname").distinct()
    h = F.col("hostname")
    return hosts.select("hostname", U.lookalike_text(h).alias("plain"), U.lookalike_brand(h).alias("brand"), U.lookalike_brand(h, True).alias("brand_registered_mode"))


@query
def f16_token_brands(v):
    return v.urls.select("url").distinct().select("url", U.token_brand(U.upload_host(U.upload_url(F.col("url")))).alias("brand"))


@query
def f17_shortener_tld(v):
    df = U.url_parts(v.urls.select("url").distinct())
    h = F.col("hostname")
    return df.select("url", U.gateway_shortener(h, F.col("root_domain")).alias("gateway_shortener"), U.upload_shortener(h).alias("upload_shortener"), U.suffix_match(h, R.GATEWAY_TLDS).alias("gateway_tld"), U.suffix_match(h, R.UPLOAD_TLDS).alias("upload_tld"))


@query
def f18_url_reasons(v):
    return U.assess(v.urls.select("url").distinct()).select("url", F.explode_outer("reasons").alias("reason"))


@query
def f19_file_names(v):
    p = v.attachment_payloads.select("message_id", "pos", "original_filename").unionByName(
        v.messages.select("message_id", F.posexplode(scoring.names_array()).alias("pos", "original_filename")).withColumn("pos", F.col("pos").cast("bigint")))
    n = F.col("original_filename")
    safe = files.safe_name(n, F.lit("attachment.bin"))
    return p.select("message_id", *big("pos"), "original_filename", safe.alias("safe_name"), files.suffix(safe).alias("suffix"), files.is_dangerous(safe, n).alias("dangerous"), files.has_double_suffix(safe).alias("double_suffix"), files.ends_with_any(n, R.UPLOAD_EXECUTABLES).alias("executable"))


@query
def f20_authentication(v):
    p = H.authentication(H.sender_identity(H.with_headers(v.messages)))
    return p.select("message_id", *[F.col(f"auth.{k}.status").alias(k) for k in ("spf", "dkim", "dmarc", "arc")], *[F.col(f"auth.{k}.risk").cast("bigint").alias(f"{k}_risk") for k in ("spf", "dkim", "dmarc", "arc")],
                    F.col("auth.spf.reason").alias("spf_reason"), F.col("auth.spf.domain").alias("spf_domain"), F.col("auth.dkim.domain").alias("dkim_domain"), F.col("auth.dmarc.policy").alias("dmarc_policy"), *big("auth_score"), "is_authenticated")


@query
def f21_sender_identity(v):
    return H.sender_identity(H.with_headers(v.messages)).select("message_id", "from_name", "from_addr", "from_domain", "reply_addr", "return_addr", "reply_mismatch", "return_mismatch", "name_holds_address", "claimed_brand", *big("spoofing_score", "sender_trust_score"))


@query
def f22_header_integrity(v):
    p = H.integrity(H.sender_identity(H.with_headers(v.messages)))
    return p.select("message_id", "mid_domain", *big("integrity_score"), joined(F.transform("integrity_findings", lambda f: f["finding"])).alias("findings"))


@query
def f23_mail_clients(v):
    m = H.with_headers(v.messages)
    return m.select("message_id", H.mail_client(F.col("fields")).alias("client"), H.originating_ip(F.col("fields")).alias("originating_ip"))


@query
def f24_hop_fields(v):
    return routing.hop_fields(v.messages).select("message_id", *big("seq"), "from_host", "by_host", "from_ip", "protocol", "auth_info", "timestamp_raw", "ip_type", "is_internal", "relay_type", joined("observations").alias("observations"))


@query
def f24_chain_fields(v):
    return routing.chain_fields(v.messages).select("message_id", *big("seq"), "sending_host", "receiving_host", "ip", "chain_protocol", "tls", "ip_category", "ip_is_private")


@query
def f25_rfc_dates(v):
    m = H.with_headers(v.messages)
    return m.select("message_id", F.explode(F.array_append(F.transform("received", H.hop_stamp), F.col("date_hdr"))).alias("raw")).select("message_id", "raw", dates.rfc_epoch(F.col("raw")).alias("epoch"))


@query
def f26_delay_text(v):
    s = (F.col("event_id") * 37 % 200000 - 500).cast("double")
    return v.base("events").select("event_id", s.alias("seconds"), dates.delay_text(s).alias("display"))


@query
def f27_url_hashes(v):
    u = F.col("url").cast("binary")
    return v.urls.select("url").distinct().select("url", F.md5(u).alias("md5"), F.sha1(u).alias("sha1"), F.sha2(u, 256).alias("sha256"))


@query
def f28_policy_decisions(v):
    d = v.enforceable.withColumn("findings", analyst.list_of("findings_text"))
    return d.select("message_id", *big("risk_score"), bands.decision(F.col("risk_score")).alias("decision"), bands.decision_reason(F.col("risk_score"), F.col("findings")).alias("reason"))


@query
def f29_status_labels(v):
    return v.enforceable.select("message_id", bands.scan_verdict(F.col("severity")).alias("verdict"), bands.risk_tone(bands.scan_verdict(F.col("severity"))).alias("tone"))


@query
def f30_json_lists(v):
    return v.legacy_scans.select("id", joined(analyst.json_list("categories_json")).alias("categories"), F.size(analyst.json_list("categories_json")).cast("bigint").alias("n"))


@query
def f31_location_labels(v):
    df = enrichment.with_location_label(enrichment.enrich(v.ips, v.networks))
    return df.select("event_id", "clean_ip", "location_display", "display_city", "display_region", "display_country", "display_code", "display_owner", "flag")


@query
def f32_quarantine_ids(v):
    return quarantined(v).select("message_id", "tenant_id", "quarantine_id")


def stream_of(v: Views, view: str, table: str, batches: int | None = None) -> DataFrame:
    """A view over the stream of the files of its base table; with ``batches``, the table lands in so many micro-batches,
    each of as many files as there are cores."""
    folder, schema, per = f"{v.sf_dir}/{table}.parquet*", v.base(table).schema, 16
    if batches:
        folder, per = new_folder(v.spark, f"landed-{table}"), batch_files(v.spark)
        v.base(table).repartition(batches * per).write.parquet(folder)
    landed = v.spark.readStream.schema(schema).option("maxFilesPerTrigger", per).parquet(folder)
    return v.spark.sql(VIEWS[view], **{table: landed})


# ---- state and flow ------------------------------------------------------------------------

@query
def st1_ingest_stream(v):
    """The attempts are landed files, four micro-batches; every repeat of a message id is ignored."""
    out = new_folder(v.spark, "ingest")
    landed = stream_of(v, "attempts", "events", 4).withColumn("received_at", F.col("attempted_at").cast("timestamp"))
    jobs.run_ingest(landed, f"{out}/jobs", f"{out}/checkpoint").awaitTermination()
    return v.spark.read.parquet(f"{out}/jobs").select("message_id", "status")


def named_parts(messages: DataFrame) -> DataFrame:
    """Attachment parts of the mail view, whose payloads follow from their names."""
    parts = messages.select("message_id", F.posexplode(scoring.names_array()).alias("pos", "original_filename"))
    return parts.withColumns({"mime_type": F.lit("application/octet-stream"), "content": F.concat(F.lit("bytes of "), "original_filename")})


def scored_stream(v: Views, table: str) -> DataFrame:
    """Three micro-batches of landed messages through the scoring stream; one of its tables."""
    out = new_folder(v.spark, "scoring")
    jobs.run_scoring_stream(stream_of(v, "messages", "documents", 3), out, f"{out}/checkpoint", named_parts).awaitTermination()
    return jobs.scored_table(v.spark, out, table)


@query
def st2_scoring_stream(v):
    """Micro-batches of landed messages through the same scoring job as the batch side."""
    return scored_stream(v, "messages").select("message_id", *big("risk_score"), "severity", "decision", "final_status")


@query
def st2_attachments(v):
    return scored_stream(v, "attachments").select("message_id", "sha256", *big("pos", "size_bytes"), "original_filename", "filename")


@query
def st2_quarantine(v):
    return scored_stream(v, "quarantine").select("message_id", "tenant_id", "quarantine_id", "original_sender", "recipient", "subject", *big("risk_score"), "severity", "status")


@query
def st2_audit(v):
    rows = scored_stream(v, "audit")
    return rows.select("message_id", "tenant_id", "action", "actor_id", *big("risk_score"), F.coalesce(F.get_json_object("details", "$.quarantine_id"), F.lit("")).alias("quarantine_id"),
                       F.substring_index(F.get_json_object("details", "$.reason"), ".", 1).alias("reason_head"))


@query
def st2_scans(v):
    return scored_stream(v, "scans").select("sender", "subject")


@query
def st3_retry_stream(v):
    out = new_folder(v.spark, "retries")
    jobs.run_retries(stream_of(v, "attempts", "events"), f"{out}/facts", f"{out}/checkpoint").awaitTermination()
    return jobs.retry_states(v.spark, f"{out}/facts")


@query
def st3_retry_fold(v):
    return enforcement.fold_attempts(v.attempts)


@query
def st4_enforcement(v):
    return decided(v).select("message_id", "tenant_id", "decision", "reason", "final_status")


@query
def st4_audit_rows(v):
    return enforcement.audit_rows(decided(v)).groupBy("tenant_id", "action", "actor_id").agg(F.count(F.lit(1)).alias("events"), F.sum("risk_score").cast("bigint").alias("risk_sum"))


@query
def st5_release_flow(v):
    return enforcement.flow_states(decided(v), v.release_requests, quarantined(v)).select("message_id", "start", *big("requests"), "state")


@query
def st6_relay_results(v):
    return enforcement.relay_results(v.relay_outcomes, decided(v)).select("message_id", "tenant_id", "relay_host", *big("smtp_code"), "status", "audit_action")


@query
def st7_live_cache(v):
    cache = v.attempts.select("message_id", "attempt_no", F.col("attempted_at").alias("cached_at"), F.when(F.col("outcome") == "ok", R.POSITIVE_TTL_SECONDS).otherwise(R.NEGATIVE_TTL_SECONDS).alias("ttl"))
    latest = cache.agg(F.max("cached_at")).scalar()
    return enforcement.live_entries(cache, latest, F.col("ttl")).select("message_id", *big("attempt_no"))


def cache_requests(v: Views) -> DataFrame:
    """Lookups of a cache key in time order; those of clicks and errors find nothing."""
    return v.base("events").select(F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("cache_key"), F.col("event_id").alias("request_id"),
                                   F.col("ts").cast("timestamp").alias("requested_at"), F.when(~F.col("event_type").isin("click", "error"), F.col("event_type")).alias("value"))


@query
def st7_cache_stream(v):
    """The lookups land in three batches one after the other, so that answers are kept, and expire, between them."""
    out, spark = new_folder(v.spark, "cache"), v.spark
    requests = cache_requests(v)
    cuts = requests.select(F.unix_micros("requested_at").alias("t")).approxQuantile("t", [1 / 3, 2 / 3], 0.01)
    number = F.lit(0)
    for cut in cuts:
        number = number + F.when(F.unix_micros("requested_at") > cut, 1).otherwise(0)
    for n in range(3):  # the files of a batch must not be split over two: the later ones would be late
        requests.where(number == n).repartition(batch_files(spark)).write.mode("append").parquet(f"{out}/landed")
        landed = spark.readStream.schema(requests.schema).parquet(f"{out}/landed")
        jobs.run_cache(landed, f"{out}/lookups", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/lookups").select("cache_key", "request_id", "hit", "value", F.unix_seconds("valid_until").alias("valid_until"))


@query
def st8_audit_defaults(v):
    e = v.base("events").withColumn("name", F.when(F.col("event_type") == "signup", "login_success").when(F.col("event_type") == "view", "logout").otherwise(F.col("event_type")))
    e = e.withColumn("who", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("user"), F.col("user_id").cast("string")))).withColumn("kind", F.when(F.col("event_id") % 5 == 0, "scan"))
    out = enforcement.audit_events(e, F.col("name"), F.col("who"), F.col("kind"))
    return out.select("event_id", "event", "actor_name", "target_type")


# ---- correlation and response --------------------------------------------------------------

@query
def c01_threat_graph(v):
    return correlation.graph_nodes(v.scans).select("node_id", "node_group", "label", "risk", *big("emails"))


@query
def c02_campaigns(v):
    return correlation.campaigns(v.scans).select("node_id", "node_group", *big("emails", "max_risk", "high_risk_mentions"))


@query
def c02_campaign_components(v):
    c = correlation.campaign_components(v.scans, ("domain", "url"))
    return c.select("scan_id", "component")


@query
def c02_campaign_batches(v):
    """The same from three appended batches of scans, each of which touches its own components only."""
    nodes = KeyedTable(v.spark, new_folder(v.spark, "campaign-nodes"), correlation.NODE_ROW, ["node_id"], ["step"], buckets=8)
    parents = KeyedTable(v.spark, new_folder(v.spark, "campaign-forest"), PARENT_ROW, ["v"], ["step"], buckets=8)
    for n in range(3):
        correlation.grow_campaigns(nodes, parents, v.scans.where(F.col("scan_id") % 3 == n), n)
    return correlation.kept_campaigns(nodes, parents, v.scans)


@query
def c03_playbooks(v):
    return correlation.playbooks(v.scans).select("scan_id", joined("playbook_ids").alias("playbook_ids"), joined("actions").alias("actions"))


@query
def c04_fleet_blocklist(v):
    return correlation.fleet_blocklist(v.scans)


@query
def c05_delivery_timeline(v):
    out = routing.delivery_timeline(v.messages)
    return out.select("message_id", *big("total_hops"), "has_timeline", "summary_message", "max_delay_display", "avg_delay_display", "first_received_raw", "final_delivery_raw", "total_delivery_time")


@query
def c06_mailbox_rescan(v):
    return postdelivery.rescan(mailboxes(v)).select("user_email", "message_id", *big("risk_score"), "severity", "action_taken", "audit_action")


@query
def c07_geo_context(v):
    m = indicator_rows(v).select("message_id", "ip_addresses")
    return enrichment.geo_context(m, v.networks).select("message_id", *big("pos"), "ip", "address_type", *big("ip_version"), "display_city", "display_region", "display_country", "timezone", "network", "location_display")


@query
def c08_attachment_links(v):
    out = ingest.attachment_links(v.attachment_payloads.withColumnRenamed("payload", "content"))
    return out.select("message_id", *big("pos"), "original_filename", joined("pdf_urls").alias("pdf_urls"), joined("qr_urls").alias("qr_urls"), *big("quishing_score"))


@query
def x02_feed_union(v):
    feeds = v.reputation.withColumn("provider", F.lit("url_feed")).unionByName(v.reputation)
    return indicators.reputation(scan_iocs(v), feeds).withColumn("confidence", F.round("confidence", 6))


@query
def x03_policy_bands(v):
    strict = [("ALLOW", 0, 9), ("REVIEW", 10, 49), ("QUARANTINE", 50, 79), ("REJECT", 80, 100)]
    return v.enforceable.select("message_id", bands.decision(F.col("risk_score"), strict).alias("decision"))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn):
        return lambda spark, sf_dir: fn(Views(spark, sf_dir))
    return {name: bind(fn) for name, fn in QUERIES.items()}
