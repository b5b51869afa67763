"""Attachment file-name rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from . import rules as R
from .text import blank


def suffix(name: Column) -> Column:
    """Last suffix with its dot, lower case; a leading dot alone is not a suffix."""
    base = F.regexp_extract(blank(name), r"([^/]*)$", 1)
    return F.lower(F.regexp_extract(F.regexp_replace(base, r"^\.+", ""), r"^.+(\.[^.]*)$", 1))


def ends_with_any(name: Column, suffixes: list[str]) -> Column:
    low = F.lower(blank(name))
    return reduce(lambda a, s: a | low.endswith(s), suffixes, F.lit(False))


def is_dangerous(name: Column, original: Column) -> Column:
    return suffix(name).isin(R.GATEWAY_DANGEROUS) | suffix(original).isin(R.GATEWAY_DANGEROUS)


def has_double_suffix(name: Column) -> Column:
    parts = F.split(blank(name), r"\.")
    return (F.size(parts) > 2) & F.lower(F.get(parts, F.size(parts) - 2)).isin(R.DOUBLE_EXT_INNER)


def is_image(name: Column, mime: Column) -> Column:
    return F.contains(F.lower(blank(mime)), F.lit("image")) | ends_with_any(name, R.IMAGE_SUFFIXES)


def safe_name(name: Column, fallback: Column) -> Column:
    """Base name on either separator, unsafe characters and '..' to '_', outer dots and blanks cut,
    at most 180 characters (170 of the stem and 10 of the suffix)."""
    return _bounded(_cleaned(name), fallback)


def named_parts(names: Column) -> Column:
    """array<struct<n, s, ns, ss, parts>>: each name with its safe form, both suffixes and the safe form's pieces. The
    steps hand over structs, so that no step's work is repeated by the next."""
    first = F.transform(names, lambda n: F.struct(n.alias("n"), _cleaned(n).alias("t")))
    safe = F.transform(first, lambda x: F.struct(x["n"].alias("n"), _bounded(x["t"], x["n"]).alias("s")))
    return F.transform(safe, lambda x: F.struct(x["n"].alias("n"), x["s"].alias("s"), suffix(x["n"]).alias("ns"), suffix(x["s"]).alias("ss"), F.split(blank(x["s"]), r"\.").alias("parts")))


def dangerous_part(x: Column) -> Column:
    return x["ss"].isin(R.GATEWAY_DANGEROUS) | x["ns"].isin(R.GATEWAY_DANGEROUS)


def inner_suffix(x: Column) -> Column:
    """The piece before the last one, lower case; null if there are fewer than three pieces."""
    return F.when(F.size(x["parts"]) > 2, F.lower(F.get(x["parts"], F.size(x["parts"]) - 2)))


def double_part(x: Column) -> Column:
    return F.coalesce(inner_suffix(x).isin(R.DOUBLE_EXT_INNER), F.lit(False))


def _cleaned(name: Column) -> Column:
    base = F.regexp_extract(blank(name), r"([^/\\]*)$", 1)
    t = F.regexp_replace(base, r'[\x00-\x1f\x7f-\x9f<>:"/\\|?*]', "_")
    return F.regexp_replace(F.replace(t, F.lit(".."), F.lit("_")), r"^[. ]+|[. ]+$", "")


def _bounded(t: Column, fallback: Column) -> Column:
    ext = F.regexp_extract(t, r"^.+(\.[^.]*)$", 1)
    stem = F.regexp_replace(t, r"(?<=.)\.[^.]*$", "")
    cut = F.concat(F.substring(stem, 1, 170), F.substring(ext, 1, 10))
    return F.when(t == "", fallback).when(F.length(t) > 180, cut).otherwise(t)
