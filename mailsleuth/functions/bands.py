"""Score bands: severity, verdict, policy decision."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import rules as R


def clamp(score: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), score.cast("int")))


def _banded(score: Column, bands, pick: int) -> Column:
    out = None
    for band in bands:
        test = score >= band[0]
        out = F.when(test, band[pick]) if out is None else out.when(test, band[pick])
    return out


def severity(score: Column) -> Column:
    return _banded(score, R.SEVERITY_BANDS, 1)


def recommendation(score: Column) -> Column:
    return _banded(score, R.SEVERITY_BANDS, 2)


def verdict(score: Column) -> Column:
    return _banded(score, R.VERDICT_BANDS, 1)


def url_level(score: Column) -> Column:
    return F.coalesce(_banded(score, R.URL_LEVELS, 1), F.lit("Safe"))


def scan_verdict(sev: Column) -> Column:
    """Verdict a gateway message gets in the scan table."""
    return F.when(sev == "CRITICAL", "High Risk").otherwise(F.concat(F.initcap(sev), F.lit(" Risk")))


def risk_tone(verdict_: Column) -> Column:
    return F.when(verdict_ == "High Risk", "danger").when(verdict_ == "Medium Risk", "warning").otherwise("success")


def validate_policy(bands=R.POLICY_BANDS) -> list[tuple[str, int, int]]:
    """Bands must lie in 0..100, rise, and leave no gap; anything else is a ValueError."""
    for name, lo, hi in bands:
        for v in (lo, hi):
            if isinstance(v, bool) or not isinstance(v, int) or not 0 <= v <= 100:
                raise ValueError(f"policy band {name}: {v!r} is not an integer in 0..100")
        if lo > hi:
            raise ValueError(f"policy band {name}: {lo} is above {hi}")
    for (a, _, hi), (b, lo, _) in zip(bands, bands[1:]):
        if lo != hi + 1:
            raise ValueError(f"policy bands {a} and {b} overlap or leave a gap")
    if bands[0][1] != 0 or bands[-1][2] != 100:
        raise ValueError("policy bands must cover 0..100")
    return list(bands)


def decision(score: Column, bands=R.POLICY_BANDS) -> Column:
    s, out = clamp(score), None
    for name, _, hi in validate_policy(bands):
        out = F.when(s <= hi, name) if out is None else out.when(s <= hi, name)
    return out


def decision_reason(score: Column, findings: Column, bands=R.POLICY_BANDS) -> Column:
    s, out = clamp(score), None
    named = F.array_join(findings, "; ")
    summary = F.when(F.size(findings) > 0, named).otherwise("Deterministic risk score evaluation")
    for name, lo, hi in validate_policy(bands):
        head = F.concat(F.lit("Risk score "), s.cast("string"))
        text = (F.concat(head, F.lit(f" is within ALLOW threshold (0-{hi}).")) if name == "ALLOW" else
                F.concat(head, F.lit(f" requires analyst REVIEW ({lo}-{hi}). "), summary) if name == "REVIEW" else
                F.concat(head, F.lit(f" triggered {name} policy ({lo}-{hi}). "), summary))
        out = F.when(s <= hi, text) if out is None else out.when(s <= hi, text)
    return out


def final_status(decision_: Column) -> Column:
    return (F.when(decision_ == "ALLOW", "READY_FOR_RELAY").when(decision_ == "REVIEW", "REVIEW")
            .when(decision_ == "QUARANTINE", "QUARANTINED").when(decision_ == "REJECT", "REJECTED").otherwise("FAILED"))


def quarantine_id(message_id: Column, tenant_id: Column, day: Column) -> Column:
    """Deterministic, so a repeated run writes the same id."""
    return F.concat(F.lit("QUAR-"), day, F.lit("-"),
                    F.substring(F.sha2(F.concat(message_id, F.lit("|"), tenant_id), 256), 1, 8))
