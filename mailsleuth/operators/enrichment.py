"""Address enrichment from a network table, by longest prefix match for IPv4 and IPv6 alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import ip as IP, rules as R
from ..session import stored
from .skew import HOT_SHARE, attach_unique

# columns of the two sides of a network table, with what stands for a missing one
PLACE = {"country": "string", "country_code": "string", "region": "string", "city": "string", "latitude": "double", "longitude": "double", "timezone": "string"}
OWNER = {"asn": "bigint", "organization": "string", "network": "string"}
# there are fewer than 2 ** (SHORT + 1) prefixes of at most SHORT bits for each version, so these can be broadcast
SHORT = 12


def network_index(networks: DataFrame) -> DataFrame:
    """Stored: version, length, hi, lo (prefix bits), place, owner; one row for each prefix. ``networks`` has CIDR texts of
    either version in ``network``, and any of the columns above and ``build_date``. Rows that are no networks are left
    out; bits beyond the length are ignored; of several rows of one prefix the smallest place and owner count."""
    have = lambda c, kind: F.col(c).cast(kind) if c in networks.columns else F.lit(None).cast(kind)
    text = lambda c, kind: F.coalesce(have(c, kind), F.lit("Unknown")) if kind == "string" else have(c, kind)
    df = networks.select(*[text(c, kind).alias(c) for c, kind in {**PLACE, **OWNER}.items()], have("build_date", "string").alias("build_date"))
    df = df.withColumn("length", F.substring_index("network", "/", -1).try_cast("int"))
    df = IP.with_ip_flags(df, F.substring_index("network", "/", 1), "_f", "_b")
    # stored before the filter, which the optimizer would else copy through all steps of the address rules
    df = stored(df.drop("_f"), "parsed-networks")
    df = df.where(F.col("_b").isNotNull() & F.contains("network", F.lit("/")) & F.col("length").between(0, F.when(F.col("_b.version") == 4, 32).otherwise(128)))
    upper, lower = IP.prefix_masks(F.col("length"))
    place = F.when((F.col("city") != "Unknown") | (F.col("country") != "Unknown"), F.struct(*PLACE, "build_date"))
    owner = F.when(F.col("asn").isNotNull() | (F.col("organization") != "Unknown"), F.struct(*OWNER, "build_date"))
    df = df.select(F.col("_b.version").alias("version"), "length", F.col("_b.hi").bitwiseAND(upper).alias("hi"), F.col("_b.lo").bitwiseAND(lower).alias("lo"), place.alias("place"), owner.alias("owner"))
    return stored(df.groupBy("version", "length", "hi", "lo").agg(F.min("place").alias("place"), F.min("owner").alias("owner")), "network-index")


def probes(bits: str, lengths: dict[int, list[int]]) -> Column:
    """The prefixes of an address of every length that networks of its version have."""
    def of(version: int) -> Column:
        own = []
        for n in lengths.get(version, []):
            upper, lower = IP.prefix_masks(F.lit(n))
            own.append(F.struct(F.lit(n).alias("length"), F.col(bits)["hi"].bitwiseAND(upper).alias("hi"), F.col(bits)["lo"].bitwiseAND(lower).alias("lo")))
        return F.array(*own) if own else F.array().cast("array<struct<length:int,hi:bigint,lo:bigint>>")
    return F.when(F.col(bits)["version"] == 4, of(4)).when(F.col(bits)["version"] == 6, of(6))


def prefix_hits(addresses: DataFrame, index: DataFrame) -> DataFrame:
    """Every network that holds an address, for distinct rows of clean_ip and bits (null: not looked up).

    An address asks once for each length that occurs in the index (161 at most, mostly some 25), by equality on the
    prefix, so an address meets as many rows as networks hold it, however many lie side by side. Prefixes of
    at most ``SHORT`` bits, which can hold most addresses, are broadcast; there is only a bounded number of them."""
    lengths: dict[int, list[int]] = {}
    for r in index.select("version", "length").distinct().orderBy("version", "length").collect():
        lengths.setdefault(r["version"], []).append(r["length"])
    asked = addresses.where(F.col("bits").isNotNull())
    keys, hits = ["version", "length", "hi", "lo"], None
    for short in (True, False):
        some = {v: [n for n in own if (n <= SHORT) == short] for v, own in lengths.items()}
        rows = asked.select("clean_ip", F.col("bits.version").alias("version"), F.explode(probes("bits", some)).alias("p")).select("clean_ip", "version", "p.*")
        side = index.where(F.col("length") <= SHORT) if short else index.where(F.col("length") > SHORT)
        found = rows.join(F.broadcast(side) if short else side, keys)
        hits = found if hits is None else hits.unionByName(found)
    return hits


def network_lookup(addresses: DataFrame, index: DataFrame) -> DataFrame:
    """Place and owner of the longest matching prefix that has one, for each address with a match."""
    best = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("length"))).alias(c)
    return prefix_hits(addresses, index).groupBy("clean_ip").agg(best("place"), best("owner"))


def located(addresses: DataFrame, networks: DataFrame, label: str) -> DataFrame:
    """Stored: class and geo columns of distinct addresses (clean_ip)."""
    df = IP.with_ip_flags(addresses, F.col("clean_ip"), "_f", "_b")
    df = df.select("clean_ip", IP.geo_class(F.col("_f")).alias("address_type"), F.when(F.col("_f.version") == 6, 6).otherwise(4).alias("ip_version"), F.col("_b").alias("bits"))
    df = stored(df.withColumn("bits", F.when(F.col("address_type") == "public", F.col("bits"))), "classed-addresses")
    df = df.join(network_lookup(df, network_index(networks)), "clean_ip", "left")
    public, has_place, has_owner = F.col("address_type") == "public", F.col("place").isNotNull(), F.col("owner").isNotNull()
    missing = F.when(public, "Unknown").otherwise("Unavailable")
    side = F.when(has_place & has_owner, f"{label} (City + ASN)").when(has_place, f"{label} City").otherwise(f"{label} ASN")
    columns = {c: (kind, F.col(s)[c]) for s, cs in (("place", PLACE), ("owner", OWNER)) for c, kind in cs.items()}
    return stored(df.select(
        "clean_ip", "address_type", "ip_version", *[(F.coalesce(c, missing) if kind == "string" else c).alias(name) for name, (kind, c) in columns.items()],
        F.coalesce(F.col("place.build_date"), F.col("owner.build_date")).alias("build_date"),
        F.when(has_place | has_owner, "table").otherwise("none").alias("source"), F.when(has_place | has_owner, "ok").otherwise("unavailable").alias("status"),
        F.when(has_place | has_owner, side).when(public | (F.col("clean_ip") == ""), "None").otherwise("None (Non-Public IP)").alias("provider_used")), "located-addresses")


def enrich(df: DataFrame, networks: DataFrame, col: str = "ip", label: str = "network table") -> DataFrame:
    """Geo columns for an address column. One count of the addresses gives the distinct ones, which are classed and
    looked up once, and the hot ones; the result is joined back hot-key safe, as one relay address may sit in a third
    of all rows."""
    df = df.withColumn("clean_ip", IP.clean(F.col(col)))
    counts = stored(df.groupBy("clean_ip").agg(F.count("*").alias("n")), "addresses")
    hot = counts.where(F.col("n") * HOT_SHARE > counts.agg(F.sum("n")).scalar()).select("clean_ip")
    return attach_unique(df, located(counts.select("clean_ip"), networks, label), ["clean_ip"], hot)


def with_location_label(df: DataFrame) -> DataFrame:
    """Display defaults on top of ``enrich``: private subnet, gateway node, region, owner, flag."""
    public = F.col("address_type") == "public"
    code = F.when(~F.col("country_code").isin("Unknown", "Unavailable"), F.col("country_code")).when(public, "US").otherwise("LOCAL")
    flag = F.when(F.lit(False), "")
    for c, f in R.COUNTRY_FLAGS.items():
        flag = flag.when(code == c, f)
    flag = flag.otherwise(F.when(public, "🌐").otherwise("🏠"))
    known = lambda c, default: F.when(F.col(c) != "Unknown", F.col(c)).otherwise(default)
    city, country, org = known("city", "Public Gateway Node"), known("country", "Public Internet"), known("organization", "Internet Service Provider")
    full = (F.col("city") != "Unknown") & (F.col("country") != "Unknown")
    label = (F.when(~public, F.concat(F.lit("🏠 Private Subnet ("), F.initcap(F.replace(F.col("address_type"), F.lit("-"), F.lit("- "))), F.lit(")")))
             .when(full, F.concat(flag, F.lit(" "), city, F.lit(", "), country, F.lit(" ("), org, F.lit(")")))
             .otherwise(F.concat(flag, F.lit(" Public Internet IP Node ("), org, F.lit(")"))))
    return df.withColumns({"location_display": F.replace(label, F.lit("- "), F.lit("-")),
                           "display_city": F.when(public, city).otherwise("Local / Internal Network"),
                           "display_country": F.when(public, country).otherwise("Private Subnet"), "display_code": code,
                           "display_region": F.when(public, known("region", "Global Subnet")).otherwise("Intranet"), "display_owner": F.when(public, org).otherwise("Private Subnet"), "flag": flag})


def geo_context(messages: DataFrame, networks: DataFrame, max_lookups: int | None = None) -> DataFrame:
    """Location rows of the addresses of each message (array column ``ip_addresses``); None takes all."""
    taken = F.col("ip_addresses") if max_lookups is None else F.slice("ip_addresses", 1, max_lookups)
    ips = messages.select("message_id", F.posexplode(taken).alias("pos", "ip"))
    return with_location_label(enrich(ips, networks))
