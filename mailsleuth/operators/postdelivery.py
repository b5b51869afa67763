"""Rescans of delivered mailboxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import rules as R
from .scoring import gateway_scores


def action(score: Column, threshold: int = R.POSTDELIVERY_THRESHOLD, remediation: str = "TRASH") -> Column:
    """Only TRASH changes a message; any other remediation is logged as ALLOWED."""
    hit = F.lit(remediation == "TRASH") & (score >= threshold)
    return F.when(hit, "TRASHED").otherwise("ALLOWED")


def rescan(mailboxes: DataFrame, threshold: int = R.POSTDELIVERY_THRESHOLD, remediation: str = "TRASH") -> DataFrame:
    """Score, action and audit flag for every landed message. ``mailboxes`` is a message table with user_email;
    one mail in several mailboxes is a row in each."""
    return gateway_scores(mailboxes, findings=False).select("user_email", "message_id", F.lit(None).cast("string").alias("thread_id"), F.col("from_hdr").alias("sender"), "subject", "risk_score", "severity",
                     action(F.col("risk_score"), threshold, remediation).alias("action_taken"),
                     F.when(F.col("risk_score") >= threshold, "POST_DELIVERY_QUARANTINED").alias("audit_action"))


def rescan_totals(rescans: DataFrame) -> DataFrame:
    """Per mailbox and over all (user_email null)."""
    return rescans.rollup("user_email").agg(F.count(F.lit(1)).alias("total_scanned"),
                                            F.count_if(F.col("action_taken").isin("TRASHED", "LABELED_QUARANTINE")).alias("total_remediated"))
