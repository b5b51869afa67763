"""Several tables written by one micro-batch and committed together.

Every attempt of a batch writes its tables into folders of its own (``<table>/batch_id=<n>/attempt=<id>``). Only when all
of them are there, one small file goes to ``ledger/batch_id=<n>``; it names the attempt and the rows of each table, and
appears as a whole or not at all. Readers join with the ledger, so that a batch that broke off half-way, or
the remains of an attempt that was overtaken, is in no table. A batch that is in the ledger is not done again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from ..session import children

LEDGER = "table_name string, attempt string, n_rows long, batch_id long"


def ledger(spark: SparkSession, out: str) -> DataFrame:
    """table_name, attempt, n_rows, batch_id of all commits. Should two drivers have committed one batch, the smaller
    attempt counts, for every reader."""
    if not children(spark, f"{out}/ledger"):
        return spark.createDataFrame([], LEDGER)
    rows = spark.read.schema(LEDGER).parquet(f"{out}/ledger")
    first = rows.groupBy("batch_id").agg(F.min("attempt").alias("attempt"))
    return rows.join(first, ["batch_id", "attempt"], "left_semi").select("table_name", "attempt", "n_rows", "batch_id")


def is_committed(spark: SparkSession, out: str, batch_id: int) -> bool:
    return bool(ledger(spark, out).where(F.col("batch_id") == batch_id).take(1))


def commit_tables(spark: SparkSession, out: str, batch_id: int, build: Callable[[Callable[..., DataFrame]], None]) -> bool:
    """Run ``build(put)``, where ``put(name, df, by)`` writes a table of this batch, parted by columns, and gives it back
    as stored, so that later tables need not compute it again; then commit. False if the batch was committed before."""
    if is_committed(spark, out, batch_id):
        return False
    attempt, counts = uuid.uuid4().hex, {}

    def put(name: str, df: DataFrame, by: list[str] | None = None) -> DataFrame:
        seen, folder = Observation(), f"{out}/{name}/batch_id={batch_id}/attempt={attempt}"
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.partitionBy(*by or []).parquet(folder)
        counts[name] = seen.get["n"]
        return spark.read.schema(df.schema).parquet(folder)

    build(put)
    entry = spark.createDataFrame([(name, attempt, n) for name, n in counts.items()], "table_name string, attempt string, n_rows long")
    entry.coalesce(1).write.mode("append").parquet(f"{out}/ledger/batch_id={batch_id}")
    return True


def committed(spark: SparkSession, out: str, name: str, schema: T.StructType | None = None) -> DataFrame:
    """Rows of a table from committed batches, with ``batch_id``. Folders of other attempts are pruned by the join. A plan
    should read a table once, or as it is at one time: Spark takes two scans of one folder for the same."""
    reader = spark.read.schema(T.StructType([*schema, T.StructField("batch_id", T.LongType()), T.StructField("attempt", T.StringType())])) if schema else spark.read
    rows = reader.parquet(f"{out}/{name}")
    known = ledger(spark, out).where(F.col("table_name") == name).select("batch_id", "attempt")
    return rows.withColumns({"batch_id": F.col("batch_id").cast("long"), "attempt": F.col("attempt").cast("string")}).join(known, ["batch_id", "attempt"], "left_semi").drop("attempt")


def first_written(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The row of each key from the earliest batch: what is there already is not inserted again. An aggregation, which
    combines before the shuffle, so a key that lands again and again is no hot one."""
    rest = [c for c in rows.columns if c not in keys and c != "batch_id"]
    v = F.min_by(F.struct(*rest), F.struct("batch_id", *order)) if order else F.min(F.struct("batch_id", *rest))
    return rows.groupBy(*keys).agg(v.alias("v")).select(*keys, *[F.col("v")[c].alias(c) for c in rest])
