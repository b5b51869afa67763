"""Delivery timeline: hops, delays, observations, summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import dates, header as H, ip as IP
from .skew import ordered_scan


def received_lines(messages: DataFrame, raw: str = "raw_headers") -> DataFrame:
    """(message_id, seq, raw): one row per Received header, seq 1 = oldest."""
    df = messages.withColumn("_r", H.values(H.header_fields(F.col(raw)), "Received"))
    return (df.select("message_id", F.size("_r").alias("_n"), F.posexplode("_r").alias("_p", "raw"))
            .select("message_id", (F.col("_n") - F.col("_p")).alias("seq"), "raw"))


def hop_fields(messages: DataFrame) -> DataFrame:
    return H.with_timeline_fields(received_lines(messages))


def chain_fields(messages: DataFrame) -> DataFrame:
    return H.with_chain_fields(received_lines(messages))


def classify_hops(hops: DataFrame) -> DataFrame:
    """Address class of a hop table that already has its fields."""
    df = IP.with_ip_flags(hops, IP.clean(F.col("from_ip")), "_f")
    return df.withColumns({"ip_type": IP.timeline_class(F.col("_f")), "is_internal": IP.timeline_internal(F.col("_f")),
                           "is_private_relay": IP.hop_private(F.col("_f"))}).drop("_f")


def hop_delays(hops: DataFrame) -> DataFrame:
    """Hop numbers, delay to the hop before, delay to the last known timestamp, repeats and anomalies.

    Needs message_id, seq (rising from the oldest hop), from_host, from_ip, hop_epoch."""
    df = ordered_scan(hops, "message_id", "seq", ["from_host", "from_ip", "hop_epoch"], "hop_epoch")
    p, first = F.col("prev"), F.col("row_no") == 1
    same_ip = (F.col("from_ip") != "") & (F.col("from_ip") == p["from_ip"])
    same_host = (F.col("from_host") != "") & (F.col("from_host") == p["from_host"]) & ~F.col("from_host").isin("unknown", "localhost")
    df = df.withColumns({
        "hop_no": F.col("row_no").cast("bigint"),
        "delay_seconds": F.when(first, F.lit(0.0)).otherwise((F.col("hop_epoch") - p["hop_epoch"]).cast("double")),
        "known_delay": (F.col("hop_epoch") - F.col("last_known")).cast("double"),
        "is_duplicate": F.coalesce(same_ip, F.lit(False)) | F.coalesce(same_host, F.lit(False))})
    df = df.withColumns({
        "delay_display": F.when(first, "0s (Initial Hop)").otherwise(dates.delay_text(F.col("delay_seconds"))),
        "timing_finding": F.when(F.col("known_delay") < -60, "Chronological Clock Skew / Out-of-Order Timestamp")
                          .when(F.col("known_delay") > 86400, "Excessive Delivery Transit Delay"),
        "_obs": F.array_compact(F.array(
            F.when(F.col("is_duplicate"), "Duplicate relay"), F.when(F.col("delay_seconds") < 0, "Timestamp anomaly"),
            F.when(F.col("delay_seconds") < 0, "Out-of-order timestamps"),
            F.when(~first & F.col("delay_seconds").isNull(), "Missing timestamp")))})
    have = F.col("observations") if "observations" in hops.columns else F.array().cast("array<string>")
    return df.withColumn("observations", F.array_distinct(F.concat(have, F.col("_obs")))).drop("_obs", "prev", "row_no", "last_known")


def delivery_summary(hops: DataFrame) -> DataFrame:
    """One row per message; the result of ``hop_delays`` with ``is_internal`` goes in. Sums, extremes
    and min_by/max_by combine on the map side."""
    counted = F.when(F.col("hop_no") > 1, F.col("delay_seconds"))
    stamp = F.col("timestamp_raw") if "timestamp_raw" in hops.columns else F.col("hop_epoch").cast("string")
    ends = F.struct(F.col("hop_no"), stamp.alias("raw"), F.col("hop_epoch").alias("ts"))
    df = hops.groupBy("message_id").agg(
        F.count(F.lit(1)).alias("total_hops"), F.count_if("is_internal").alias("internal_hops"), F.max(counted).alias("max_delay"),
        F.sum(counted).alias("_sum"), F.count(counted).alias("_n"), F.min(ends).alias("_a"), F.max(ends).alias("_z"))
    total = F.when(F.col("total_hops") > 1, F.col("_z.ts") - F.col("_a.ts"))
    df = df.withColumns({"avg_delay": F.when(F.col("_n") > 0, F.col("_sum") / F.col("_n")), "_total": total.cast("double")})
    shown = lambda c: F.when((c.isNull()) | (c == ""), "Timestamp Unavailable").otherwise(c)
    return df.select(
        "message_id", "total_hops", "internal_hops", (F.col("total_hops") - F.col("internal_hops")).alias("external_hops"),
        "max_delay", "avg_delay", dates.delay_text(F.col("max_delay")).alias("max_delay_display"), dates.delay_text(F.col("avg_delay")).alias("avg_delay_display"),
        shown(F.col("_a.raw")).alias("first_received_raw"), shown(F.col("_z.raw")).alias("final_delivery_raw"),
        dates.delay_text(F.col("_total")).alias("total_delivery_time"))


def delivery_timeline(messages: DataFrame) -> DataFrame:
    """Summary of every message, also of those without a delivery path."""
    summary = delivery_summary(hop_delays(hop_fields(messages)))
    df = messages.select("message_id").join(summary, "message_id", "left")
    has = F.col("total_hops").isNotNull()
    return df.withColumns({
        "has_timeline": has, "total_hops": F.coalesce("total_hops", F.lit(0)),
        "summary_message": F.when(has, F.concat(F.lit("Reconstructed "), F.col("total_hops").cast("string"), F.lit(" mail server relay hops.")))
                            .otherwise("No delivery path available.")})


def routing_totals(messages: DataFrame) -> DataFrame:
    return H.routing_totals(H.with_headers(messages)).select(
        "message_id", "hop_count", "total_transit_seconds", "private_relay_count", "timing_issues", "infrastructure_trust_score")
