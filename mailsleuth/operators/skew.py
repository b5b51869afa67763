"""Joins and ordered scans that hold when one key owns a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stored

HOT_SHARE = 1000


def hot_keys(df: DataFrame, keys: list[str], share: int = HOT_SHARE) -> DataFrame:
    """Keys that own more than 1/share of the rows. There are fewer than ``share`` of them, whatever
    the size of the data, so the result is safe to broadcast."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    return counts.where(F.col("_n") * share > total).select(*keys)


def attach_unique(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame | None = None) -> DataFrame:
    """Left join to a side that is unique on ``keys``, safe for hot and null keys on the left.

    Right rows of hot keys (a proven handful) are broadcast. All other rows take a shuffle join, in
    which rows already served, and rows with a null key, get a salt of their own: they match nothing
    and spread evenly instead of piling up in one task. No row is dropped."""
    hot = hot_keys(left, keys) if hot is None else hot
    extra = [c for c in right.columns if c not in keys]
    hot_right = right.join(F.broadcast(hot), keys, "left_semi").select(
        *keys, F.struct(*extra).alias("_h"))
    kinds = dict(left.dtypes)
    spread = [c for c in left.columns if "map<" not in kinds[c]]
    nulls = F.lit(False)
    for k in keys:
        nulls = nulls | F.col(k).isNull()
    marked = left.join(F.broadcast(hot_right), keys, "left").withColumn(
        "_salt", F.when(F.col("_h").isNotNull() | nulls, F.xxhash64(*spread)).otherwise(F.lit(None).cast("bigint")))
    marked = marked.withColumn("_side", F.when(F.col("_salt").isNull(), 0).otherwise(1)).withColumn("_salt", F.coalesce("_salt", F.lit(0)))
    cold_right = right.withColumns({"_salt": F.lit(0).cast("bigint"), "_side": F.lit(0), "_m": F.lit(True)})
    joined = marked.join(cold_right, keys + ["_salt", "_side"], "left")
    return joined.select(*[c for c in left.columns], *[
        F.when(F.col("_h").isNotNull(), F.col("_h")[c]).otherwise(F.col(c)).alias(c) for c in extra])


def range_split(df: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """Stored, with the number ``_p`` of the range of ``order`` a row lies in: ranges of about equal size, rising in that
    order. The limits are sampled, so a key with many rows, however its numbers lie, has ranges of its own; rows that
    agree in ``order`` are told apart by the rest of the row."""
    kinds = dict(df.dtypes)
    rest = F.xxhash64(*[c for c in df.columns if "map<" not in kinds[c]])
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *[F.col(c).asc_nulls_first() for c in order], rest.asc())
    return stored(ranged.withColumn("_p", F.spark_partition_id()), "ranges")


def ordered_scan(df: DataFrame, key: str, seq: str, row: list[str], known: str, parts: int | None = None) -> DataFrame:
    """Row number, previous row and last known value per key in ``seq`` order.

    A window over ``key`` alone would put a hot key into one task. The rows are split into sampled ranges of (key, seq);
    windows run inside the piece of a key in one range, and a small table with one row per piece, of which a key
    has no more than there are ranges, carries the counts and the last row over the borders.
    Adds ``row_no``, ``prev`` (struct of ``row``) and ``last_known``. Rows without ``seq`` come first, rows of one number
    in the order of ``row``; rows without a key are one group; none is dropped. Joins are null-safe for that."""
    packed, at = F.struct(*row), F.struct(F.col(seq), *row)
    split = range_split(df, [key, seq, *row], parts)
    # max and max_by see a row without a number as the smallest: null sorts first in a struct
    pieces = split.groupBy(key, "_p").agg(
        F.count(F.lit(1)).alias("_n"), F.max(at).alias("_end"), F.max_by(F.col(known), F.when(F.col(known).isNotNull(), at)).alias("_known"))
    over = Window.partitionBy(key).orderBy("_p")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(F.col(key).alias("_k"), F.col("_p").alias("_kp"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
                           F.lag("_end").over(over).alias("_carry"), F.last("_known", ignorenulls=True).over(before).alias("_carry_known"))
    inner = Window.partitionBy(key, "_p").orderBy(seq, *row)
    inside = split.withColumns({
        "_rn": F.row_number().over(inner), "_prev": F.lag(packed).over(inner),
        "_seen": F.last(known, ignorenulls=True).over(inner.rowsBetween(Window.unboundedPreceding, -1))})
    out = inside.join(pieces, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_p") == F.col("_kp")))
    carried = F.when(F.col("_carry").isNotNull(), F.struct(*[F.col("_carry")[c].alias(c) for c in row]))
    return out.select(*df.columns, (F.col("_rn") + F.col("_offset")).alias("row_no"),
                      F.when(F.col("_rn") == 1, carried).otherwise(F.col("_prev")).alias("prev"),
                      F.coalesce("_seen", "_carry_known").alias("last_known"))


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Newest version of each key by aggregation, which combines on the map side, not by a window."""
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_v"))
            .select(*keys, *[F.col("_v")[c].alias(c) for c in rest]))
