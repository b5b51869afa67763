"""IP address classes as range predicates; no per-row Python.

An address is first turned into a fixed-width text key: IPv4 into 8 and IPv6 into 32 hex
digits. Every block of the rule tables is then a BETWEEN on that key."""

from __future__ import annotations

import ipaddress
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from . import rules as R

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
RE_V4 = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"


def _v6_pattern() -> str:
    """Eight groups, or up to seven around one '::'."""
    h = "[0-9a-f]{1,4}"
    forms = [rf"{h}(?::{h}){{7}}", rf"::(?:{h}(?::{h}){{0,6}})?", rf"{h}(?::{h}){{6}}::"]
    forms += [rf"{h}(?::{h}){{{n - 1}}}::(?:{h}(?::{h}){{0,{6 - n}}})?" for n in range(1, 7)]
    return "^(?:" + "|".join(forms) + ")$"


RE_V6 = _v6_pattern()
RE_MAPPED = rf"^::ffff:({_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET})$"


def clean(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"^[\[\]() ]+|[\[\]() ]+$", "")


def v4_number(c: Column) -> Column:
    """Address as a bigint, null when the text is not a valid dotted quad."""
    p = F.split(c, r"\.")
    n = reduce(lambda a, i: a * 256 + F.get(p, F.lit(i)).try_cast("bigint"), range(1, 4),
               F.get(p, F.lit(0)).try_cast("bigint"))
    return F.when(c.rlike(RE_V4), n)


def dotted(n: Column) -> Column:
    return F.concat_ws(".", *[(F.shiftright(n, s) % 256).cast("string") for s in (24, 16, 8, 0)])


def _groups(part: Column) -> Column:
    return F.filter(F.split(part, ":"), lambda g: g != "")


def _hex4(n: Column) -> Column:
    return F.lower(F.hex(n))


# An address passes through a few small steps. Each step is one projection (or one lambda level for
# arrays), so that the later range tests refer to finished keys and the plan stays small.
_STEPS = [
    ("q", lambda g: v4_number(F.regexp_extract(g("t"), RE_MAPPED, 1))),
    ("s", lambda g: F.when(g("q").isNotNull(), F.concat(F.lit("::ffff:"), _hex4(F.shiftright(g("q"), 16)), F.lit(":"), _hex4(g("q") % 65536))).otherwise(g("t"))),
    ("n", lambda g: v4_number(g("t"))),
    ("l", lambda g: F.when(g("s").rlike(RE_V6), _groups(F.substring_index(g("s"), "::", 1)))),
    ("r", lambda g: F.when(F.contains(g("s"), F.lit("::")), _groups(F.substring_index(g("s"), "::", -1))).otherwise(F.array().cast("array<string>"))),
    ("z", lambda g: F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(g("l")) - F.size(g("r"))))),
    ("k", lambda g: F.array_join(F.transform(F.concat(g("l"), g("z"), g("r")), lambda x: F.lpad(x, 4, "0")), "")),
]


def address_bits(n: Column, k: Column) -> Column:
    """Struct of version and 128 bits as two signed longs, from the IPv4 number, which fills the upper 32 of them, or
    the IPv6 key; null for other texts."""
    half = lambda at: F.conv(F.substring(k, at, 16), 16, -10).cast("bigint")
    four = F.struct(F.lit(4).alias("version"), F.shiftleft(n, 32).alias("hi"), F.lit(0).cast("bigint").alias("lo"))
    return F.when(n.isNotNull(), four).when(k.isNotNull(), F.struct(F.lit(6).alias("version"), half(1).alias("hi"), half(17).alias("lo")))


def prefix_masks(length: Column) -> tuple[Column, Column]:
    """Masks of the two halves for a prefix of that many bits."""
    upper = lambda bits: F.call_function("shiftleft", F.lit(-1).cast("bigint"), (64 - bits).cast("int"))
    whole, none = F.lit(-1).cast("bigint"), F.lit(0).cast("bigint")
    return (F.when(length >= 64, whole).when(length <= 0, none).otherwise(upper(length)),
            F.when(length >= 128, whole).when(length <= 64, none).otherwise(upper(length - 64)))


def with_ip_flags(df: DataFrame, col: Column, out: str, bits: str | None = None) -> DataFrame:
    """Add the struct ``out`` of address properties of a text column, and its bits where a name for them is given."""
    name = lambda s: f"_ip_{s}"
    df = df.withColumn(name("t"), F.lower(F.coalesce(col, F.lit(""))))
    for step, build in _STEPS:
        df = df.withColumn(name(step), build(lambda s: F.col(name(s))))
    if bits:
        df = df.withColumn(bits, address_bits(F.col(name("n")), F.col(name("k"))))
    return df.withColumn(out, flags(F.col(name("n")), F.col(name("k")))).drop(name("t"), *[name(s) for s, _ in _STEPS])


def _level(step, build, have):
    return lambda e: F.struct(*[e[h].alias(h) for h in have], build(lambda s: e[s]).alias(step))


def flags_of_array(arr: Column, text=lambda x: x) -> Column:
    """The same for every element of an array."""
    cur = F.transform(arr, lambda x: F.struct(F.lower(F.coalesce(text(x), F.lit(""))).alias("t")))
    have = ["t"]
    for step, build in _STEPS:
        cur = F.transform(cur, _level(step, build, tuple(have)))
        have.append(step)
    return F.transform(cur, lambda e: flags(e["n"], e["k"]))


def _v4_in(n: Column, block: str) -> Column:
    net = ipaddress.IPv4Network(block)
    return n.between(int(net.network_address), int(net.broadcast_address))


def _v6_in(k: Column, block: str) -> Column:
    net = ipaddress.IPv6Network(block)
    return k.between(f"{int(net.network_address):032x}", f"{int(net.broadcast_address):032x}")


def _any(tests) -> Column:
    return reduce(lambda a, b: a | b, tests)


def flags(n: Column, k: Column) -> Column:
    """struct of version (0 = not an address), number, and the standard address properties, from the
    IPv4 number and the IPv6 key."""
    four, six = n.isNotNull(), k.isNotNull()
    pick = lambda v4, v6: F.when(four, v4).when(six, v6).otherwise(F.lit(False))
    private4 = _any(_v4_in(n, b) for b in R.IPV4_PRIVATE) & ~_any(_v4_in(n, b) for b in R.IPV4_PRIVATE_EXCEPT)
    private6 = _any(_v6_in(k, b) for b in R.IPV6_PRIVATE) & ~_any(_v6_in(k, b) for b in R.IPV6_PRIVATE_EXCEPT)
    return F.struct(
        F.when(four, 4).when(six, 6).otherwise(0).alias("version"), n.alias("number"),
        pick(_v4_in(n, "127.0.0.0/8"), k == f"{1:032x}").alias("loopback"),
        pick(private4, private6).alias("private"),
        pick(_v4_in(n, "169.254.0.0/16"), _v6_in(k, "fe80::/10")).alias("link_local"),
        pick(_v4_in(n, "240.0.0.0/4"), _any(_v6_in(k, b) for b in R.IPV6_RESERVED)).alias("reserved"),
        pick(_v4_in(n, "224.0.0.0/4"), _v6_in(k, "ff00::/8")).alias("multicast"),
        pick(n == 0, k == "0" * 32).alias("unspecified"),
        pick(_v4_in(n, R.IPV4_SHARED), F.lit(False)).alias("shared"))


def is_address(c: Column) -> Column:
    low = F.lower(c)
    return low.rlike(f"{RE_V4}|{RE_V6}|{RE_MAPPED}")


def timeline_class(f: Column) -> Column:
    return (F.when(f["version"] == 0, "Unknown").when(f["version"] == 6, "IPv6").when(f["loopback"], "Loopback")
            .when(f["link_local"], "Link-Local").when(f["reserved"], "Reserved")
            .when(f["private"], "Private IP").otherwise("Public IP"))


def timeline_internal(f: Column) -> Column:
    return f["private"] | f["loopback"] | f["link_local"] | f["reserved"] | f["unspecified"]


def hop_class(f: Column, text: Column) -> Column:
    return (F.when(text == "", "Unknown").when(f["version"] == 0, "Invalid").when(f["loopback"], "Loopback")
            .when(f["private"], "Private RFC1918").when(f["link_local"], "Link-Local").when(f["reserved"], "Reserved")
            .when(f["multicast"], "Multicast").when(f["version"] == 6, "IPv6 Public").otherwise("Public IPv4"))


def hop_private(f: Column) -> Column:
    return f["private"] | f["loopback"] | f["link_local"] | f["reserved"]


def geo_class(f: Column) -> Column:
    return (F.when(f["version"] == 0, "unknown").when(f["loopback"], "loopback").when(f["link_local"], "link-local")
            .when(f["multicast"], "multicast").when(f["reserved"] | f["unspecified"], "reserved")
            .when(f["private"], "private").when(f["shared"], "unknown").otherwise("public"))


def url_class(f: Column) -> Column:
    return (F.when(f["version"] == 0, "Domain").when(f["loopback"], "Loopback")
            .when(f["private"], "Private RFC1918").otherwise("Public IPv4"))


def restricted(f: Column) -> Column:
    """Addresses a fetcher must not touch."""
    return (f["private"] | f["loopback"] | f["link_local"] | f["reserved"] | f["multicast"] | f["unspecified"])
