"""Words, stored tables and Bloom filters shared by the operators of this subpackage."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import stored  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is; null stays null. ``lower`` is the fast way for plain ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_array(text: Column) -> Column:
    """The words of the whole text in order; null has none. Splitting is many times faster than extracting."""
    return F.array_remove(F.split(F.coalesce(ascii_lower(text), F.lit("")), NOT_WORD), "")


def ascii_words(text: Column) -> Column:
    """Number of runs of other characters than white space (blank, tab to carriage return); null has none."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def content_key(text: Column) -> Column:
    """Key under which equal texts, null among them as a text of its own, share one result."""
    return F.coalesce(F.sha2(text, 256), F.lit("null"))


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Whole texts are large rows: no more than so many go to a Python worker in one Arrow batch, which both sides hold
    in memory beside the batch that comes back. A smaller number that the session has stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


class Bloom:
    """Blocked Bloom filter as one array of 64-bit numbers. A block is four numbers; a key sets one bit in
    each, so that a probe touches one block. The array's size is set by the number of keys up to
    ``max_blocks`` (32 bytes each); with more keys only the share of false hits grows."""

    def __init__(self, keys: DataFrame, column: str, bits_per_key: int = 24, max_blocks: int = 1 << 18):
        spark = keys.sparkSession
        wanted = max(1, keys.count()) * bits_per_key / 256
        self.shift = min(max(4, math.ceil(math.log2(wanted))), int(math.log2(max_blocks)))
        part = F.explode(F.sequence(F.lit(0), F.lit(3)))
        bits = (keys.select(F.col(column).alias("_h"), part.alias("_j"))
                .select(self._slot(F.col("_h"), F.col("_j")).alias("_i"), self._bit(F.col("_h"), F.col("_j")).alias("_b"))
                .groupBy("_i").agg(F.bit_or("_b").alias("_b")))
        full = spark.range(4 << self.shift).join(bits, F.col("id") == F.col("_i"), "left")
        ordered = F.array_sort(F.collect_list(F.struct("id", F.coalesce("_b", F.lit(0).cast("long")).alias("b"))))
        self.bits = full.agg(F.transform(ordered, lambda x: x["b"]).alias("bits"))

    def _slot(self, h: Column, j: Column) -> Column:
        return F.shiftrightunsigned(h, 64 - self.shift).cast("int") * 4 + j

    @staticmethod
    def _bit(h: Column, j: Column) -> Column:
        place = F.call_function("shiftright", h, (j * 6).cast("int")).bitwiseAND(F.lit(63).cast("long"))
        return F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))

    def may_hold(self, h: Column) -> Column:
        """False only for keys that are not in the filter; a null key is not in it."""
        bits, hit = self.bits.scalar(), F.lit(True)
        for j in range(4):
            bit = self._bit(h, F.lit(j))
            hit = hit & (F.get(bits, self._slot(h, F.lit(j))).bitwiseAND(bit) != 0)
        return F.coalesce(hit, F.lit(False))
