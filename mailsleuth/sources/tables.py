"""Table sources and sinks: parquet store, relational databases, network tables, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

NETWORK_SCHEMA = T.StructType([
    T.StructField("network", T.StringType()), T.StructField("country_code", T.StringType()), T.StructField("country", T.StringType()),
    T.StructField("city", T.StringType()), T.StructField("asn", T.IntegerType()), T.StructField("organization", T.StringType()),
    T.StructField("region", T.StringType()), T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType()), T.StructField("timezone", T.StringType()), T.StructField("build_date", T.StringType())])


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet with additive schema evolution: files with fewer columns are read with nulls."""
    r = spark.read.option("mergeSchema", "true")
    return (r.schema(schema) if schema else r).parquet(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "append") -> None:
    w = df.write.mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def read_database(spark: SparkSession, url: str, table: str, split_column: str | None = None, lower: int = 0, upper: int = 0, parts: int = 16, **options) -> DataFrame:
    """JDBC table; a numeric split column lets many tasks read it side by side."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if split_column:
        r = r.option("partitionColumn", split_column).option("lowerBound", lower).option("upperBound", upper).option("numPartitions", parts)
    return r.load()


def write_database(df: DataFrame, url: str, table: str, mode: str = "append", **options) -> None:
    df.write.format("jdbc").option("url", url).option("dbtable", table).options(**options).mode(mode).save()


def with_range(networks: DataFrame) -> DataFrame:
    """First and last address of IPv4 networks in CIDR notation, by arithmetic on the columns."""
    base, bits = F.substring_index("network", "/", 1), F.substring_index("network", "/", -1).try_cast("int")
    octet = F.split(base, r"\.")
    n = F.lit(0).cast("bigint")
    for i in range(4):
        n = n * 256 + F.get(octet, F.lit(i)).try_cast("bigint")
    size = F.expr("shiftleft(1L, 32 - try_cast(substring_index(network, '/', -1) AS INT))")
    start = n - n % size
    return networks.where(bits.between(0, 32)).withColumns({"start_ip": start, "end_ip": start + size - 1})


def read_networks(spark: SparkSession, path: str) -> DataFrame:
    """Network files with a header, of either version. Files may lack the columns from ``region`` on."""
    return spark.read.schema(NETWORK_SCHEMA).option("header", "true").option("enforceSchema", "true").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def write_rules(rules: DataFrame, path: str) -> None:
    """Rule texts as line-delimited text, one folder per kind; written by all tasks."""
    for kind in ("yara", "sigma"):
        rules.select(F.col(kind).alias("value")).write.mode("overwrite").option("lineSep", "\n").text(f"{path}/{kind}")
