"""RFC 2822 dates to epoch seconds, and the display text of delays."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import rules as R

_DATE = (r"(?i)^\s*(?:[a-z]{3,9},?\s+)?([0-9]{1,2})\s+(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+"
         r"([0-9]{4}|[0-9]{2})\s+([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?(?:\s+([+-][0-9]{4}|[a-z]{1,5}))?(?:\s*\(.*\))?\s*$")


def rfc_epoch(c: Column) -> Column:
    """UTC epoch seconds as bigint, null for text that is no date. Independent of the session time zone."""
    g = lambda i: F.regexp_extract(c, _DATE, i)
    num = lambda i: g(i).try_cast("bigint")
    month = F.array_position(F.array(*[F.lit(m) for m in R.MONTHS]), F.lower(g(2)))
    year = F.when(F.length(g(3)) == 4, num(3)).when(num(3) < 69, num(3) + 2000).otherwise(num(3) + 1900)
    day = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"),
                      F.lpad(g(1), 2, "0")).try_cast("date")
    zone = F.upper(g(7))
    named = F.lit(0)
    for name, off in R.ZONE_OFFSETS.items():
        if off:
            named = F.when(zone == name, off).otherwise(named)
    off = F.when(zone.rlike("^[+-]"), zone.try_cast("int")).otherwise(named)
    off_seconds = F.signum(off).cast("bigint") * ((F.abs(off) / 100).cast("bigint") * 3600 + F.abs(off) % 100 * 60)
    return F.when(g(2) != "", F.unix_date(day).cast("bigint") * 86400 + num(4) * 3600 + num(5) * 60
                  + F.coalesce(num(6), F.lit(0)) - off_seconds)


def delay_text(s: Column) -> Column:
    whole = s.cast("bigint")
    text = lambda n: n.cast("string")
    minutes, rest = F.floor(s / 60), F.floor(s).cast("bigint") % 60
    return (F.when(s.isNull(), "Unknown")
            .when(s < 0, F.concat(text(F.abs(whole)), F.lit("s (Clock Skew Anomaly)")))
            .when(s < 60, F.concat(text(whole), F.lit("s")))
            .when((minutes < 60) & (rest == 0), F.concat(text(minutes), F.lit("m")))
            .when(minutes < 60, F.concat(text(minutes), F.lit("m "), text(rest), F.lit("s")))
            .otherwise(F.concat(text(F.floor(minutes / 60)), F.lit("h "), text(minutes % 60), F.lit("m"))))
