"""Skew helpers against the plain form, and the shape of physical plans."""

import re

from pyspark.sql import Window, functions as F

from mailsleuth.operators import analyst, scoring, skew
from mailsleuth.plans.catalog import QUERIES
from mailsleuth.plans.fixtures import Views

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_attach_unique_with_hot_and_null_keys(spark):
    left = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 11 == 0, None).otherwise(F.col("id") % 400).cast("int").alias("k"))
    right = spark.range(390).select(F.col("id").cast("int").alias("k"), (F.col("id") * 2).alias("v"))
    got = skew.attach_unique(left, right, ["k"]).orderBy("id").collect()
    want = left.join(right, "k", "left").select("id", "k", "v").orderBy("id").collect()
    assert got == want
    assert skew.hot_keys(left, ["k"]).count() <= skew.HOT_SHARE


def scanned(df, **options):
    out = skew.ordered_scan(df, "key", "seq", ["val"], "ts", **options)
    return sorted(map(tuple, out.select("key", "seq", "val", F.col("row_no").alias("n"), F.col("prev.val").alias("p"), F.col("last_known").alias("k")).collect()), key=repr)


def windowed(df):
    w = Window.partitionBy("key").orderBy("seq", "val")
    out = df.select("key", "seq", "val", F.row_number().over(w).alias("n"), F.lag("val").over(w).alias("p"), F.last("ts", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("k"))
    return sorted(map(tuple, out.collect()), key=repr)


def test_ordered_scan_equals_one_window(spark):
    df = spark.range(500).select((F.col("id") % 4).cast("string").alias("key"), F.col("id").alias("seq"), F.when(F.col("id") % 9 == 0, F.col("id")).alias("ts"), F.col("id").alias("val"))
    odd = df.select(F.when(F.col("key") != "2", F.col("key")).alias("key"), F.when(F.col("seq") % 7 != 0, F.floor(F.col("seq") / 11) * 10 ** 9).alias("seq"), "ts", "val")
    for table in (df, odd, df.limit(0)):
        want = windowed(table)
        for parts in (1, 5, 40):
            assert scanned(table, parts=parts) == want


def test_hot_key_is_dealt_evenly(spark):
    """Half of all rows have one key, with sparse, repeated and null numbers."""
    n = F.col("id")
    df = spark.range(40_000).select(F.when(n % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), (n % 3001).cast("string"))).alias("key"),
                                    F.when(n % 6 == 0, None).when(n % 6 == 2, 5).otherwise(n * n * 1000).alias("seq"), F.when(n % 9 == 0, n).alias("ts"), n.alias("val"))
    sizes = sorted(r["count"] for r in skew.range_split(df, ["key", "seq", "val"], 32).groupBy("_p").count().collect())
    assert len(sizes) == 32 and sizes[-1] <= 3 * sizes[16]
    assert scanned(df, parts=32) == windowed(df)


def test_no_query_plans_a_cross_join(spark):
    v = Views(spark, SF)
    for name in ("a14_gateway_score", "a15_upload_score", "j05_network_lookup", "p07_indicator_search", "j08_score_back", "c01_threat_graph", "j09_release_results"):
        text = plan(QUERIES[name](v))
        assert "CartesianProduct" not in text and "NestedLoop" not in text, name


def test_message_scoring_has_one_shuffle(spark):
    text = plan(scoring.gateway_scores(Views(spark, SF).messages))
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1


def test_filters_and_columns_reach_the_scan(spark):
    v = Views(spark, SF)
    text = plan(analyst.search_users(v.users, role="admin").select("user_id"))
    assert "EqualTo(c_mktsegment,BUILDING)" in text or "PushedFilters" in text
    scan = plan(QUERIES["p01_visible_scans"](v))
    assert "o_orderpriority" not in scan.split("ReadSchema")[-1]
