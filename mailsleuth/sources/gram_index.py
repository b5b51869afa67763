"""Kept index for substring search: which texts hold which runs of one to three characters, and which rows hold which texts.

A row's text is taken apart into its columns, which ``SEP`` divides; a term stands inside one of them. Columns repeat from
row to row (an address, a host, a subject), so only their distinct values are cut into grams: a row costs one entry for
each of its values, a value one posting for each of its grams, once. Postings (gram, value) lie by bucket of the gram and sorted
by it, entries (value, row id) by bucket of the value, so that a search opens the buckets of its grams and, for few
terms, the row groups that can hold them. How many values hold a gram is kept beside, one small row per gram and batch; a
term is looked up by the rarest of its longest grams. Batches of new rows are appended, all tables together through
the ledger; nothing written before is touched, and a batch that broke off is not there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import children, stored
from ..streaming import ledger

SIZES, PUSHED = (1, 2, 3), 64
SEP = "\u0001"


def grams(text: Column, size: Column | int) -> Column:
    """Distinct runs of that many characters."""
    size = F.lit(size) if isinstance(size, int) else size
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1)))
    found = F.when((size > 0) & (F.length(text) >= size), F.transform(starts, lambda i: F.substring(text, i, size)))
    return F.array_distinct(F.coalesce(found, F.array().cast("array<string>")))


def every_gram(text: Column) -> Column:
    """The grams of all indexed sizes."""
    return F.concat(*[grams(text, n) for n in SIZES])


def values_of(text: Column) -> Column:
    """The distinct columns of a row's text that hold anything, in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(text), SEP), lambda x: x != ""))


def term_grams(terms: DataFrame) -> DataFrame:
    """term, gram: the runs of the longest indexed size that a distinct lower-cased term has."""
    parts = terms.select("term", F.explode(values_of(F.col("term"))).alias("part"))
    return parts.select("term", F.explode(grams(F.col("part"), F.least(F.length("part"), F.lit(SIZES[-1])))).alias("gram")).distinct()


def rarest_gram(own: DataFrame, counts: DataFrame, *carried: str) -> DataFrame:
    """term, ``carried``, gram: of a term's grams the one that the fewest values hold, by ``counts`` (gram, n)."""
    best = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), *carried, "gram")).alias("r")
    return own.join(counts, "gram", "left").groupBy("term").agg(best).select("term", *[f"r.{c}" for c in carried], "r.gram")


def fits() -> Column:
    """Whether a value holds the term, before its rows are looked up. A term with a divider in it is in none, and left to
    a test of the whole text; dividers alone are no term."""
    return F.contains("value", F.lower("term")) | F.contains("term", F.lit(SEP))


class GramIndex:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 32):
        self.spark, self.path, self.buckets = spark, path, buckets

    def bucket(self, c: str = "gram") -> Column:
        return F.pmod(F.xxhash64(c), F.lit(self.buckets)).cast("int")

    def append(self, rows: DataFrame, batch_id: int) -> bool:
        """Add rows (id, text); False for a batch that is there already. Texts are compared in lower case."""
        def build(put):
            entries = rows.select(F.col("id").cast("long").alias("id"), F.explode(values_of(F.col("text"))).alias("value")).withColumn("bucket", self.bucket("value"))
            # range partitions of (bucket, value, id): a value that most rows hold is many partitions
            kept = put("entries", entries.repartitionByRange("bucket", "value", "id").sortWithinPartitions("bucket", "value", "id"), ["bucket"])
            new = kept.select("value").distinct()
            if children(self.spark, f"{self.path}/ledger"):
                new = new.join(ledger.committed(self.spark, self.path, "values").select("value"), "value", "left_anti")
            new = put("values", new)
            postings = new.select("value", F.explode(every_gram(F.col("value"))).alias("gram")).withColumn("bucket", self.bucket())
            kept = put("postings", postings.repartitionByRange("bucket", "gram", "value").sortWithinPartitions("bucket", "gram", "value"), ["bucket"])
            put("counts", kept.groupBy("bucket", "gram").agg(F.count(F.lit(1)).alias("n")).repartition("bucket"), ["bucket"])

        return ledger.commit_tables(self.spark, self.path, batch_id, build)

    def _few(self, wanted: DataFrame, c: str) -> Column | None:
        """Test for the wanted buckets and values of column ``c``, where these are so few that the reader can make it."""
        few = wanted.select("bucket", c).distinct().limit(PUSHED + 1).collect()
        return F.col("bucket").isin(sorted({r["bucket"] for r in few})) & F.col(c).isin(sorted({r[c] for r in few})) if len(few) <= PUSHED else None

    def candidates(self, terms: DataFrame) -> DataFrame:
        """term, id of the rows that have a value with the rarest gram of a term; what holds the term is among them."""
        own = term_grams(terms.select("term").distinct()).withColumn("bucket", self.bucket())
        counts = ledger.committed(self.spark, self.path, "counts").join(own.select("bucket", "gram").distinct(), ["bucket", "gram"])
        rarest = stored(rarest_gram(own, counts.groupBy("gram").agg(F.sum("n").alias("n")), "bucket"), "rarest-grams")
        postings = ledger.committed(self.spark, self.path, "postings").select("bucket", "gram", "value")
        entries = ledger.committed(self.spark, self.path, "entries").select("bucket", "value", "id")
        few = self._few(rarest, "gram")
        held = (postings if few is None else postings.where(few)).join(rarest, ["bucket", "gram"]).where(fits()).select("term", "value").withColumn("bucket", self.bucket("value"))
        if few is None:
            held = stored(held, "held-values")
        few = self._few(held, "value")
        return (entries if few is None else entries.where(few)).join(held, ["bucket", "value"]).select("term", "id").distinct()
