"""Longest prefix match against Python's own address arithmetic."""

import ipaddress
import random

from pyspark.sql import functions as F

from mailsleuth.functions import ip as IP
from mailsleuth.operators import enrichment


def bits_of(spark, texts):
    df = IP.with_ip_flags(spark.createDataFrame([(t,) for t in texts], "clean_ip string"), F.col("clean_ip"), "_f", "bits")
    return df.select("clean_ip", "bits")


def test_prefixes_match_like_ipaddress(spark):
    rng = random.Random(4)
    nets = ["0.0.0.0/0", "::/0", "8000::/1", "255.255.255.255/32", "ffff:ffff::/32", "1.2.3.4/32", "2001:db8::1/128", "::ffff:1.2.3.0/120"]
    for _ in range(300):
        if rng.random() < 0.5:
            nets.append(f"{ipaddress.IPv4Address(rng.choice([0x2D000000, 0xD0000000]) + rng.randrange(1 << 14))}/{rng.randrange(4, 33)}")
        else:
            nets.append(f"{ipaddress.IPv6Address((rng.choice([0x2A02, 0xFE00]) << 112) + (rng.randrange(64) << rng.choice([0, 58, 64, 100])))}/{rng.randrange(0, 129)}")
    bad = ["1.2.3.0/33", "::/129", "1.2.3.4", "x/8", None, "1.2.3.4/-1", "/8", "1.2.3.4/x"]
    table = spark.createDataFrame([(n, f"c{i}") for i, n in enumerate(nets + bad)], "network string, city string")
    index = enrichment.network_index(table)
    known = {ipaddress.ip_network(n, strict=False) for n in nets}
    assert index.count() == len(known)
    texts = ["1.2.3.4", "1.2.3.5", "255.255.255.255", "::", "::1", "2001:db8::1", "2001:db8::2", "ffff:ffff::9", "8000::", "7fff::", "::ffff:1.2.3.9", "0.0.0.0", "x", ""]
    texts += [str(n[rng.randrange(min(n.num_addresses, 1 << 20))]) for n in sorted(known, key=str)] + [str(n[-1]) for n in sorted(known, key=str)]
    hits = enrichment.prefix_hits(bits_of(spark, sorted(set(texts))), index).groupBy("clean_ip").agg(F.sort_array(F.collect_list("length")).alias("lengths"))
    got = {r["clean_ip"]: r["lengths"] for r in hits.collect()}
    for t in set(texts):
        try:
            a = ipaddress.ip_address(t)
        except ValueError:
            assert t not in got
            continue
        assert got.get(t, []) == sorted(n.prefixlen for n in known if n.version == a.version and a in n), t


def test_sides_come_from_the_longest_prefix_that_has_them(spark):
    nets = [("20.0.0.0/8", "DE", "Unknown", None, "Unknown"), ("20.1.0.0/16", "Unknown", "Unknown", 7, "Unknown"), ("20.1.2.0/24", "FR", "Paris", None, "Unknown"), ("20.1.2.3/32", "Unknown", "Unknown", None, "Unknown"),
            ("2a00::/12", "Unknown", "Rome", None, "Unknown"), ("2a00:1::/32", "Unknown", "Unknown", None, "Org"), ("2a00:1::/32", "Unknown", "Unknown", None, "Or")]
    table = spark.createDataFrame(nets, "network string, country string, city string, asn int, organization string")
    ips = spark.createDataFrame([(i, t) for i, t in enumerate(["20.1.2.3", "20.1.9.9", "20.9.9.9", "2a00:1::5", "2a01::1", "30.0.0.1", "10.0.0.1", "fe80::1", "[20.1.2.3]", "no", "", None])], "id long, ip string")
    got = {r["id"]: (r["country"], r["city"], r["asn"], r["organization"], r["provider_used"], r["ip_version"]) for r in enrichment.enrich(ips, table, label="t").collect()}
    none = ("Unavailable", "Unavailable", None, "Unavailable")
    assert got == {0: ("FR", "Paris", 7, "Unknown", "t (City + ASN)", 4), 1: ("DE", "Unknown", 7, "Unknown", "t (City + ASN)", 4), 2: ("DE", "Unknown", None, "Unknown", "t City", 4),
                   3: ("Unknown", "Rome", None, "Or", "t (City + ASN)", 6), 4: ("Unknown", "Rome", None, "Unknown", "t City", 6), 5: ("Unknown", "Unknown", None, "Unknown", "None", 4),
                   6: (*none, "None (Non-Public IP)", 4), 7: (*none, "None (Non-Public IP)", 6), 8: ("FR", "Paris", 7, "Unknown", "t (City + ASN)", 4), 9: (*none, "None (Non-Public IP)", 4), 10: (*none, "None", 4), 11: (*none, "None", 4)}


def test_networks_side_by_side_give_no_pairs(spark):
    """65,536 networks in one /16, and an equal number of addresses there: every address meets its two networks."""
    nets = spark.range(65536).select(F.concat(F.lit("20.1."), F.floor(F.col("id") / 256).cast("string"), F.lit("."), (F.col("id") % 256).cast("string"), F.lit("/32")).alias("network"), F.col("id").cast("string").alias("city"))
    index = enrichment.network_index(nets.unionByName(spark.createDataFrame([("20.1.0.0/16", "all")], "network string, city string")))
    addresses = IP.with_ip_flags(nets.select(F.substring_index("network", "/", 1).alias("clean_ip")), F.col("clean_ip"), "_f", "bits").select("clean_ip", "bits")
    hits = enrichment.prefix_hits(addresses, index)
    assert hits.count() == 2 * 65536
    text = hits._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text and "sequence(" not in text


def test_empty_network_table(spark):
    table = spark.createDataFrame([], "network string, city string, country string, asn int, organization string")
    ips = spark.createDataFrame([(1, "20.1.2.3"), (2, "2a00::1")], "id long, ip string")
    assert {r["country"] for r in enrichment.enrich(ips, table).collect()} == {"Unknown"}
