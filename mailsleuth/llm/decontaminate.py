"""Benchmark decontamination as a prefix-filtered set join.

An item's windows are its runs of ``window`` words (a shorter item is one window); a window's shingles are its runs of
``width`` words (of all its words if it has fewer). A document contains a window only if it contains all its shingles,
so one of them, the rarest over all documents, is the whole necessary prefix:

1. every shingle of every document meets a Bloom filter of all windows' shingles; the few that pass keep their
   place and the words around, and are stored;
2. their exact counts over all documents order the shingles by rarity, and each window keeps its rarest one; a
   window with a shingle that no document has drops out;
3. stored places join the prefix shingles; positional bounds (the window must begin and end inside the document)
   come before the exact comparison of the words.

Results are joined back by the digest of the text, so copies share one result. Defined results: a null or wordless
document has no words and no hits; a null or wordless item has no windows; items of one id count once, a null id as
the empty string; an empty benchmark or table gives no hits or no rows; ties in rarity go to the smaller hash, then
the earlier place; further columns of ``docs`` stay, except those named like a result, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import Bloom, content_key, stored, word_array

WINDOW, WIDTH = 10, 5
RESULTS = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def shingle(hashes: str, at: Column, width: int) -> Column:
    """Hash of ``width`` words from place ``at``, from the words' own hashes."""
    return F.xxhash64(F.lit(width), *[F.get(F.col(hashes), at + k) for k in range(width)])


def item_windows(items: DataFrame, window: int = WINDOW, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, words (of the window) for every window of every item."""
    rows = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item_id"), word_array(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    return rows.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("words")).distinct()


def window_shingles(windows: DataFrame, width: int = WIDTH) -> DataFrame:
    """words, length, offset, width, s for every shingle of every distinct window."""
    rows = windows.select("words").distinct().withColumns({"h": F.transform("words", lambda w: F.xxhash64(w)), "length": F.size("words")})
    parts = None
    for k in range(1, width + 1):
        own = rows.where((F.col("length") >= width) if k == width else (F.col("length") == k))
        own = own.select("words", "length", "h", F.lit(k).alias("width"), F.explode(F.sequence(F.lit(0), F.col("length") - k)).alias("offset"))
        own = own.withColumn("s", shingle("h", F.col("offset"), k)).drop("h")
        parts = own if parts is None else parts.unionByName(own)
    return parts


def possible_places(docs: DataFrame, shingles: DataFrame, text: str, window: int) -> DataFrame:
    """Stored rows of two kinds: one per document with null ``_s``, and one per place whose shingle may be a window's,
    with _pos, _s and the words around it, the first of which stands at ``_from``. Columns of ``docs`` but the text stay."""
    bloom = Bloom(shingles.select("s").distinct(), "s")
    widths = sorted(r["width"] for r in shingles.select("width").distinct().collect())  # five numbers at most
    rows = docs.withColumns({"_key": content_key(F.col(text)), "_w": word_array(F.col(text))}).drop(text)
    rows = rows.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w))).withColumn("n_words", F.size("_w").cast("long"))
    kind = "array<struct<_pos:int,_width:int,_s:bigint>>"

    def places_of(k: int) -> Column:
        place = lambda i: F.struct(i.alias("_pos"), F.lit(k).alias("_width"), shingle("_h", i, k).alias("_s"))
        return F.when(F.size("_h") >= k, F.transform(F.sequence(F.lit(0), F.size("_h") - k), place)).otherwise(F.array().cast(kind))

    own = F.array(F.struct(F.lit(None).cast("int").alias("_pos"), F.lit(None).cast("int").alias("_width"), F.lit(None).cast("long").alias("_s"))).cast(kind)
    every = rows.select("*", F.explode(F.concat(own, *[places_of(k) for k in widths])).alias("_p")).select("*", "_p.*").drop("_p", "_h")
    passed = every.where(F.col("_s").isNull() | bloom.may_hold(F.col("_s")))
    low = F.greatest(F.col("_pos") - (window - F.col("_width")), F.lit(0))
    around = F.slice("_w", low + 1, F.lit(2 * window) - F.col("_width"))
    return stored(passed.withColumns({"_from": low, "_words": around}).drop("_w", "_width"), "decontaminate")


def occurrences(places: DataFrame, shingles: DataFrame) -> DataFrame:
    """_key, words, start, stop for every verified occurrence of a window; ``places`` as stored."""
    spots = places.where(F.col("_s").isNotNull()).select("_key", "n_words", F.col("_pos").alias("pos"), F.col("_s").alias("s"), F.col("_from").alias("from"), F.col("_words").alias("words"))
    counts = spots.groupBy("s").agg(F.count("*").alias("n"))
    ranked = shingles.join(counts, "s", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = ranked.groupBy("words", "length").agg(F.min(F.struct("n", "s", "offset")).alias("r")).where(F.col("r.n") > 0)
    prefix = rarest.select(F.col("words").alias("window"), "length", F.col("r.s").alias("s"), F.col("r.offset").alias("offset"))
    met = spots.join(prefix, "s").withColumn("start", F.col("pos") - F.col("offset"))
    met = met.where((F.col("start") >= 0) & (F.col("start") + F.col("length") <= F.col("n_words")))
    same = F.slice("words", F.col("start") - F.col("from") + 1, F.col("length")) == F.col("window")
    return met.where(same).select("_key", F.col("window").alias("words"), "start", (F.col("start") + F.col("length")).alias("stop"))


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", window: int = WINDOW, width: int = WIDTH) -> DataFrame:
    """``docs`` without the text column, with ``_key`` (digest of the text), n_words, n_hit, n_items,
    items_sha256, contaminated and ``spans`` (start and stop of every run of words that is a window, from 0, in order)."""
    windows = stored(item_windows(items, window), "item-windows")
    shingles = stored(window_shingles(windows, width), "item-shingles")
    places = possible_places(docs.drop(*RESULTS, "spans"), shingles, text, window)
    hits = occurrences(places, shingles).join(windows, "words")
    per_text = hits.groupBy("_key").agg(F.collect_set(F.struct("start", "stop")).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("ids"))
    covered = F.aggregate(F.array_sort("spans"), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto")), lambda a, x: F.struct(
        (a["n"] + F.greatest(x["stop"] - F.greatest(x["start"], a["upto"]), F.lit(0))).alias("n"), F.greatest(a["upto"], x["stop"]).alias("upto")))
    found = per_text.select("_key", covered["n"].alias("n_hit"), F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"), F.array_sort("spans").alias("spans"))
    # both sides of the join are plain scans, so that Spark can split the rows of a text with many copies
    both = places.where(F.col("_s").isNull()).drop("_pos", "_s", "_from", "_words").join(stored(found, "contaminated-spans"), "_key", "left")
    none = {"n_hit": F.lit(0).cast("long"), "n_items": F.lit(0).cast("long"), "items_sha256": F.sha2(F.lit(""), 256), "spans": F.array().cast("array<struct<start:int,stop:int>>")}
    both = both.withColumns({c: F.coalesce(F.col(c), v) for c, v in none.items()})
    return both.withColumn("contaminated", F.col("n_hit") > 0)


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", window: int = WINDOW, width: int = WIDTH) -> DataFrame:
    """``docs`` without the documents that hold a window of an item. Only texts that a Bloom filter of the hit texts lets
    through are joined; all others pass as they are."""
    shingles = stored(window_shingles(item_windows(items, window), width), "item-shingles")
    places = possible_places(docs.select(text), shingles, text, window)
    hit = stored(occurrences(places, shingles).select("_key").distinct(), "contaminated-texts")
    bloom = Bloom(hit.select(F.xxhash64("_key").alias("h")), "h")
    rows = docs.withColumn("_key", content_key(F.col(text))).withColumn("_hit", bloom.may_hold(F.xxhash64("_key")))
    kept = rows.where("_hit").join(hit, "_key", "left_anti")
    return rows.where("not _hit").select(*docs.columns).unionByName(kept.select(*docs.columns))
