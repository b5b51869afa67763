"""URL rules over a string column. Patterns are plain literals, so Catalyst folds them once per task."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import ip as IP, rules as R
from .text import extract_all

_SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.-]*://"


def gateway_url(c: Column) -> Column:
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.when(t.rlike(_SCHEME), t).otherwise(F.concat(F.lit("http://"), t))


def upload_url(c: Column) -> Column:
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.when(t.startswith("http://") | t.startswith("https://"), t).otherwise(F.concat(F.lit("http://"), t))


def netloc(u: Column) -> Column:
    return F.regexp_extract(u, r"^[^:/?#]+://([^/?#]*)", 1)


def upload_host(u: Column) -> Column:
    """Lower-cased authority up to the first colon; credentials are not cut off."""
    return F.substring_index(F.lower(netloc(u)), ":", 1)


def scheme_of(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1))


def url_parts(df: DataFrame, col: str = "url") -> DataFrame:
    """Add the components of ``col``. Each step is its own projection, so a component is computed once."""
    df = df.withColumn("_u", gateway_url(F.col(col)))
    df = df.withColumns({
        "scheme": scheme_of(F.col("_u")), "_netloc": netloc(F.col("_u")),
        "_path": F.regexp_extract("_u", r"^[^:/?#]+://[^/?#]*([^?#]*)", 1),
        "query": F.regexp_extract("_u", r"^[^?#]*\?([^#]*)", 1),
        "fragment": F.regexp_extract("_u", r"#(.*)$", 1)})
    df = df.withColumns({
        "_user": F.when(F.contains(F.col("_netloc"), F.lit("@")), F.regexp_extract("_netloc", r"^(.*)@", 1)).otherwise(""),
        "_hostport": F.regexp_extract("_netloc", r"([^@]*)$", 1),
        "path": F.when(F.col("_path") == "", "/").otherwise(F.regexp_replace("_path", r";[^/]*$", "")),
        "params": F.regexp_extract("_path", r";([^/]*)$", 1)})
    bracket = F.col("_hostport").startswith("[")
    df = df.withColumns({
        "username": F.substring_index("_user", ":", 1),
        "password": F.regexp_extract("_user", r"^[^:]*:(.*)$", 1),
        "hostname": F.lower(F.when(bracket, F.regexp_extract("_hostport", r"^\[([^\]]*)", 1))
                            .otherwise(F.substring_index("_hostport", ":", 1))),
        "_port": F.when(bracket, F.regexp_extract("_hostport", r"\]:(.*)$", 1))
                  .otherwise(F.regexp_extract("_hostport", r"^[^:]*:(.*)$", 1))})
    balanced = F.contains(F.col("_netloc"), F.lit("[")) == F.contains(F.col("_netloc"), F.lit("]"))
    port = F.when(F.col("_port").rlike(r"^[0-9]{1,9}$"), F.col("_port").try_cast("int"))
    df = df.withColumns({
        "port": port,
        "is_valid": (F.length(F.trim(F.coalesce(F.col(col), F.lit("")))) > 0) & balanced
                    & ((F.col("_port") == "") | F.coalesce(port <= 65535, F.lit(False))),
        "has_credentials": (F.col("username") != "") | (F.col("password") != "")})
    df = df.withColumn("decoded_ip", decode_numeric_host(F.col("hostname")))
    df = df.withColumns({
        "numeric_ip_type": F.when(F.col("decoded_ip").isNull(), F.lit(None).cast("string"))
            .when(F.col("hostname").startswith("0x"), "Hexadecimal IP")
            .when(F.col("hostname").rlike("^[0-9]+$"), "Decimal Integer IP").otherwise("Octal IP"),
        "evaluated_host": F.coalesce("decoded_ip", "hostname")})
    df = IP.with_ip_flags(df, F.col("evaluated_host"), "_flags")
    df = df.withColumns({"is_ip": F.col("_flags.version") > 0, "ip_category": IP.url_class(F.col("_flags"))})
    df = df.withColumns({"root_domain": F.when(F.col("is_ip"), "").otherwise(root_domain(F.col("evaluated_host"))),
                         "query_param_count": query_param_count(F.col("query"))})
    df = df.withColumn("subdomain", F.when(F.col("root_domain") == "", "").otherwise(
        F.expr("substr(evaluated_host, 1, greatest(0, length(evaluated_host) - length(root_domain) - 1))")))
    shown_port = F.when(F.col("port").isNull() | F.col("port").isin(0, 80, 443), "").otherwise(F.concat(F.lit(":"), F.col("port").cast("string")))
    tail = lambda mark, c: F.when(F.col(c) == "", "").otherwise(F.concat(F.lit(mark), F.col(c)))
    df = df.withColumn("normalized_url", F.concat(F.col("scheme"), F.lit("://"), F.col("evaluated_host"), shown_port,
                                                  F.col("path"), tail(";", "params"), tail("?", "query"), tail("#", "fragment")))
    return df.drop("_u", "_netloc", "_path", "_user", "_hostport", "_port", "_flags")


def decode_numeric_host(h: Column) -> Column:
    """Dotted quad behind a hexadecimal, decimal or octal host; null for every other host."""
    hex_digits = F.regexp_extract(h, r"^0x0*([0-9a-f]{1,8})$", 1)
    hex_value = F.conv(F.when(hex_digits != "", hex_digits), 16, 10).try_cast("bigint")
    dec_digits = F.regexp_extract(h, r"^0*([0-9]{1,10})$", 1)
    dec_value = F.when(dec_digits != "", dec_digits).try_cast("bigint")
    parts = F.split(h, r"\.")
    octal = h.rlike(r"^[0-7]+(\.[0-7]+){3}$") & h.rlike(r"(^|\.)0[0-7]") & (F.length(h) <= 40)
    octal_parts = F.when(octal, F.transform(parts, lambda p: F.conv(p, 8, 10).try_cast("bigint")))
    octal_ok = F.forall(octal_parts, lambda v: v <= 255)
    return (F.when(hex_value.isNotNull(), IP.dotted(hex_value))
            .when(dec_value <= 0xFFFFFFFF, IP.dotted(dec_value))
            .when(octal_ok, F.array_join(F.transform(octal_parts, lambda v: v.cast("string")), ".")))


def root_domain(h: Column) -> Column:
    """Registered domain; two-part public suffixes keep one label more. Empty for a single label."""
    last2 = F.substring_index(h, ".", -2)
    dots = F.length(h) - F.length(F.replace(h, F.lit("."), F.lit("")))
    return (F.when(dots < 1, "").when((dots >= 2) & last2.isin(R.TWO_PART_SUFFIXES), F.substring_index(h, ".", -3))
            .otherwise(last2))


def query_param_count(q: Column) -> Column:
    """Distinct parameter names with a non-empty value."""
    pairs = F.filter(F.split(q, "&"), lambda p: p.rlike("^[^=]*=.+"))
    names = F.transform(pairs, lambda p: F.substring_index(p, "=", 1))
    return F.size(F.array_distinct(F.transform(names, lambda n: F.coalesce(F.try_url_decode(n), n))))


def entropy(s: Column) -> Column:
    """Shannon entropy in bits per character, from the length of each distinct character's removal."""
    n = F.length(s).cast("double")
    bits = lambda ch: (F.length(s) - F.length(F.replace(s, ch, F.lit("")))) / n
    total = F.aggregate(F.array_distinct(F.split(s, "")), F.lit(0.0),
                        lambda acc, ch: acc - F.when(ch == "", F.lit(0.0)).otherwise(bits(ch) * F.log2(bits(ch))))
    return F.when(F.length(s) > 0, total).otherwise(0.0)


def base64_payload(q: Column) -> Column:
    """A parameter value of 16+ base64 characters that decodes to text with a URL or an address."""
    value = lambda p: F.regexp_extract(p, "^[^=]*=(.*)$", 1)
    def hides_link(p):
        v = value(p)
        plain = F.decode(F.try_to_binary(F.when(v.rlike("^[a-zA-Z0-9+/=]{16,}$"), v), F.lit("base64")), "ISO-8859-1")
        return F.coalesce(F.contains(plain, F.lit("http://")) | F.contains(plain, F.lit("https://"))
                          | F.contains(plain, F.lit("@")), F.lit(False))
    return F.exists(F.split(q, "&"), hides_link)


def nested_urls(q: Column) -> Column:
    return F.array_distinct(extract_all(q, r"(?i)(https?%3A%2F%2F[^\s&]+|https?://[^\s&]+)"))


def is_punycode(h: Column) -> Column:
    return F.lower(h).rlike(r"(^|\.)xn--")


@F.pandas_udf(T.StringType())
def _decode_idna(s: pd.Series) -> pd.Series:
    def label(p):
        try:
            return p.encode("utf-8").decode("idna") if p.lower().startswith("xn--") else p
        except Exception:
            return p
    return s.map(lambda h: None if h is None else ".".join(label(p) for p in h.split(".")))


def unicode_host(h: Column) -> Column:
    """Readable form of a punycode host; hosts without one never reach the Arrow worker."""
    return F.coalesce(_decode_idna(F.when(is_punycode(h), h)), h)


def lookalike_text(h: Column) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), R.LOOKALIKE_SUBSTITUTIONS, F.lower(h))


def lookalike_brand(h: Column, allow_registered: bool = False) -> Column:
    """First brand whose name shows in the host or its de-obfuscated form; null when there is none."""
    low, plain = F.lower(h), lookalike_text(h)
    known = root_domain(low) if allow_registered else low
    out = F.when(F.length(h) == 0, F.lit(None).cast("string"))
    for brand, own in R.LOOKALIKE_BRANDS:
        out = out.when(~known.isin(own) & (F.contains(low, F.lit(brand)) | F.contains(plain, F.lit(brand))),
                       F.lit(brand.title()))
    return out.otherwise(F.lit(None).cast("string"))


def token_brand(h: Column) -> Column:
    """First brand that is a whole token of the host while the host is not one of its own domains."""
    host = F.substring_index(F.lower(h), ":", 1)
    out = None
    for b in R.TOKEN_BRANDS:
        test = host.rlike(rf"(^|[^a-z0-9]){b}([^a-z0-9]|$)") & ~host.rlike(rf"(^|\.){b}\.(com|org|net)$")
        out = F.when(test, F.lit(b.capitalize())) if out is None else out.when(test, F.lit(b.capitalize()))
    return out


def suffix_match(h: Column, suffixes: list[str]) -> Column:
    out = None
    for s in suffixes:
        out = F.when(h.endswith(s), F.lit(s)) if out is None else out.when(h.endswith(s), F.lit(s))
    return F.coalesce(out, F.lit(""))


def gateway_shortener(h: Column, root: Column) -> Column:
    return F.lower(h).isin(R.SHORTENERS) | F.lower(root).isin(R.SHORTENERS)


def upload_shortener(h: Column) -> Column:
    host = F.substring_index(F.lower(h), ":", 1)
    return reduce(lambda a, s: a | host.endswith("." + s), R.SHORTENERS, host.isin(R.SHORTENERS))


def is_ip_literal(netloc_: Column) -> Column:
    """Address literal in an authority, with or without brackets and port."""
    t = F.trim(netloc_)
    colons = F.length(t) - F.length(F.replace(t, F.lit(":"), F.lit("")))
    host = (F.when(t.startswith("[") & F.contains(t, F.lit("]")), F.regexp_extract(t, r"^\[([^\]]*)\]", 1))
            .when(colons == 1, F.substring_index(t, ":", 1)).otherwise(t))
    return IP.is_address(host)


def assess(df: DataFrame, col: str = "url") -> DataFrame:
    """Upload-profile reasons for a URL column: ``reasons`` array, empty when clean."""
    df = df.withColumn("_a", upload_url(F.col(col)))
    df = df.withColumns({"_net": netloc(F.col("_a")), "_h": upload_host(F.col("_a")),
                         "_pq": F.lower(F.concat(F.regexp_replace(F.regexp_extract("_a", r"^[^:/?#]+://[^/?#]*([^?#]*)", 1), r";[^/]*$", ""),
                                                 F.regexp_extract("_a", r"^[^?#]*(\?[^#]+)", 1)))})
    df = df.withColumns({"_ip": is_ip_literal(F.col("_net")), "_brand": token_brand(F.col("_h")),
                         "_tld": suffix_match(F.col("_h"), R.UPLOAD_TLDS), "_ent": F.round(entropy(F.col("_h")), 2),
                         "_words": F.array_compact(F.array(*[F.when(F.contains(F.col("_pq"), F.lit(w)), F.lit(w)) for w in R.PATH_WORDS]))})
    odd = F.col("_ip") | F.col("_brand").isNotNull() | (F.col("_tld") != "") | (F.col("_ent") > 4.2)
    reasons = F.array_compact(F.array(
        F.when(F.col("_ip") | F.col("_h").startswith("0x") | F.col("_h").rlike("^[0-9]+$"),
               "URL uses an IP address instead of a domain name."),
        F.when(F.col("_brand").isNotNull(), F.concat(F.lit("Appears to impersonate "), F.col("_brand"), F.lit(".")))
         .when(F.col("_h").startswith("xn--"), "URL uses Punycode (IDN) encoding, a potential homograph attack."),
        F.when(F.col("_tld") != "", F.concat(F.lit("Uses a high-risk top-level domain ("), F.col("_tld"), F.lit(").")))
         .when(upload_shortener(F.col("_h")), F.concat(F.lit("URL shortener service ("), F.col("_h"), F.lit(") conceals destination."))),
        F.when(F.col("_ent") > 4.2, F.concat(F.lit("Domain name has unusually high entropy ("), F.col("_ent").cast("string"),
                                             F.lit("), suggesting a random or generated domain."))),
        F.when((F.size("_words") >= 2) | ((F.size("_words") >= 1) & odd),
               F.concat(F.lit("URL path contains suspicious keywords ('"), F.array_join("_words", "', '"), F.lit("').")))))
    blank_url = F.trim(F.coalesce(F.col(col), F.lit(""))) == ""
    df = df.withColumn("reasons", F.when(blank_url, F.array().cast("array<string>")).otherwise(reasons))
    return df.drop("_a", "_net", "_h", "_pq", "_ip", "_brand", "_tld", "_ent", "_words")


def with_fetch_reason(df: DataFrame, col: str = "url") -> DataFrame:
    """Add ``fetch_reason`` and ``fetch_allowed`` after ``url_parts``: literal checks only, no name lookup.
    Numeric host forms count as the address they stand for. A name that needs a lookup has no reason yet."""
    df = IP.with_ip_flags(df, F.col("evaluated_host"), "_hf")
    host, f = F.col("hostname"), F.col("_hf")
    internal = host.isin(R.BLOCKED_HOSTS) | reduce(lambda a, s: a | host.endswith(s), R.INTERNAL_SUFFIXES, F.lit(False))
    written = F.lower(F.regexp_extract(F.trim(F.col(col)), r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))
    df = df.withColumn("fetch_reason", F.when(F.coalesce(F.col(col), F.lit("")) == "", "URL is missing or invalid.")
        .when(~written.isin("http", "https"), F.concat(F.lit("Scheme '"), written, F.lit("' is prohibited. Only HTTP and HTTPS are permitted.")))
        .when(host == "", "URL contains no hostname.")
        .when(internal, F.concat(F.lit("Host '"), host, F.lit("' is an internal domain.")))
        .when(IP.restricted(f), F.concat(F.lit("Target IP "), host, F.lit(" is a restricted internal or private address.")))
        .when(f["version"] > 0, "Valid public IP target."))
    return df.withColumn("fetch_allowed", F.col("fetch_reason").isNull() | (F.col("fetch_reason") == "Valid public IP target.")).drop("_hf")
