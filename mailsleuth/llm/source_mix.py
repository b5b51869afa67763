"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

1. Targets: sources in code point order (null last) weigh 3, 1, 2, repeating, and share ``budget`` of all words;
   no source may pass ``repeat`` times its size, and what it can't take goes to the others by weight.
2. A source's documents are dealt to shards by a seeded digest, about ``shard_docs`` documents each, so that a
   source with a third of all rows is many tasks. In a shard they stand in seeded order as one stream of words,
   cut into blocks of ``block_tokens`` words.
3. Blocks are seats: highest quotients votes / (2k + 1) give each source, and within it each shard, a whole
   number of blocks. Only quotients that can be near the last seat are listed, about two per shard.
4. In a shard with n blocks and q seats every block is taken q div n times and q mod n of them once more, evenly
   from a seeded start. That makes the words taken before any place of the stream a closed expression, so no
   block is ever a row.
5. The same expression gives every document its ``spans``: the parts of the stream's blocks that lie in it, as runs of its
   words (from 0, ``stop`` excluded) and how often each is taken. ``mixed_text`` makes the mix's text of them.

Every number follows from ids, sizes and the seed, so reruns agree. Defined results: a null text has size 0 and
takes nothing; a document of which nothing is taken has no spans and the empty text; a null source is a source of its own; repeated rows are documents of their own; null ids are
allowed; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import ascii_words

WEIGHTS = (3, 1, 2)
SPACE = r"\x20\x09-\x0D"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = 1.5, repeat: int = 2) -> DataFrame:
    """``sizes``: skey, source, source_size, docs; one row per source. Adds ``target``. With sources ordered by
    size per weight, those that reach their bound come first, so one pass of running sums finds the level."""
    order = W.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), "source")
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), turn + 1)
    rows = sizes.withColumn("weight", weight).withColumn("bound", F.col("source_size") * F.lit(repeat))
    rows = rows.withColumn("ratio", F.col("bound").cast("double") / F.col("weight"))
    full = W.partitionBy(F.lit(0))
    by_ratio = full.orderBy("ratio", F.col("source").isNull(), "source")
    upto = by_ratio.rowsBetween(W.unboundedPreceding, W.currentRow)
    level = (F.sum("source_size").over(full) * F.lit(budget) - (F.sum("bound").over(upto) - F.col("bound"))) / (
        F.sum("weight").over(full) - F.sum("weight").over(upto) + F.col("weight"))
    rows = rows.withColumn("level", level).withColumn("place", F.row_number().over(by_ratio))
    open_place = F.min(F.when(F.col("level") <= F.col("ratio"), F.col("place"))).over(full)
    rows = rows.withColumn("open", F.coalesce(open_place, F.lit(2147483647)))
    final = F.max(F.when(F.col("place") == F.col("open"), F.col("level"))).over(full)
    target = F.when(F.col("place") < F.col("open"), F.col("bound").cast("double")).otherwise(final * F.col("weight"))
    return rows.withColumn("target", target).select("skey", "source", "source_size", "docs", "target")


def seats(units: DataFrame, group: list[str], name: str) -> DataFrame:
    """Highest quotients. ``units``: group columns, unique ``unit``, ``votes``, ``most`` seats, and the group's
    ``total`` of votes, ``n_units`` and ``n_seats``. Seats that any outcome gives are counted at once, those that
    depend on the last quotient are listed and ranked. Adds the column ``name``."""
    half = F.col("n_units") / 2.0
    sure = F.when(F.col("n_seats") > half, F.floor(F.try_divide(F.col("votes") * (F.col("n_seats") - half), F.col("total")) + 0.5) - 1).otherwise(0)
    may = F.floor(F.try_divide(F.col("votes") * (F.col("n_seats") + half), F.col("total")) + 0.5) + 1
    rows = units.withColumns({"sure": F.least("most", F.greatest(F.lit(0), F.coalesce(sure, F.lit(0)))).cast("long"),
                              "may": F.least("most", F.greatest(F.lit(0), F.coalesce(may, F.lit(0)))).cast("long")})
    whole = W.partitionBy(*[F.col(g) for g in group]) if group else W.partitionBy(F.lit(0))
    rows = rows.withColumn("left", F.col("n_seats") - F.sum("sure").over(whole))
    open_ = rows.where("may > sure").select(*group, "unit", "votes", "left", F.explode(F.sequence("sure", F.col("may") - 1)).alias("k"))
    rank = F.row_number().over(whole.orderBy((F.col("votes") / (F.col("k") * 2 + 1)).desc(), "unit", "k"))
    won = open_.withColumn("rank", rank).where(F.col("rank") <= F.col("left")).groupBy("unit").agg(F.count("*").alias("won"))
    return (rows.join(won, "unit", "left").withColumn(name, F.col("sure") + F.coalesce("won", F.lit(0)))
            .drop("sure", "may", "left", "won"))


def digest_number(*parts: Column) -> Column:
    """Whole number of 32 bits from the parts' digest."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def mix_sources(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, budget: float = 1.5, repeat: int = 2,
                block_tokens: int = 64, shard_docs: int = 1024, doc_id: str = "doc_id", text: str = "text", source: str = "source",
                with_text: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, quota (seats of the document's shard), taken, spans (start, stop,
    times); ``with_text`` adds the mixed text of every document."""
    own = [F.col(text).alias("_text")] if with_text else []
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), ascii_words(F.col(text)).alias("size"), *own)
    rows = rows.withColumn("skey", F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source"))))
    sizes = rows.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    sources = source_targets(sizes, weights, budget, repeat)
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    dealt = (rows.join(sources.select("skey", "source_size", "docs", "target"), "skey")
             .withColumn("shard", digest_number(F.lit(seed), F.lit("shard"), ident) % F.ceil(F.col("docs") / shard_docs))
             .withColumn("turn", F.md5(F.concat_ws(":", F.lit(seed), F.lit("turn"), ident)))
             .repartition("skey", "shard"))  # else the rows stay as the join on skey dealt them
    shards = dealt.groupBy("skey", "shard").agg(F.sum("size").alias("words"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    shards = (shards.withColumn("blocks", F.ceil(F.col("words") / block_tokens))
              .withColumns({"votes": F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size") * F.col("blocks")).otherwise(0.0), "most": F.col("blocks") * repeat})
              .withColumn("unit", F.concat_ws(":", F.lpad(F.col("shard").cast("string"), 12, "0"), "skey")))
    per_source = shards.groupBy("skey").agg((F.try_divide(F.first("target"), F.first("source_size")) * F.sum("blocks")).alias("votes"), F.sum("most").alias("most"), F.count("*").alias("n_shards"))
    per_source = per_source.select("skey", F.col("skey").alias("unit"), F.coalesce("votes", F.lit(0.0)).alias("votes"), "most", "n_shards")
    every = W.partitionBy(F.lit(0))
    per_source = per_source.withColumns({"total": F.sum("votes").over(every.orderBy("skey").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), "n_units": F.count("*").over(every)})
    per_source = seats(per_source.withColumn("n_seats", F.round("total").cast("long")), [], "n_seats_won")
    groups = per_source.select("skey", F.col("votes").alias("total"), F.col("n_shards").alias("n_units"), F.col("n_seats_won").alias("n_seats"))
    quotas = seats(shards.select("skey", "shard", "unit", "votes", "most", "words", "blocks").join(groups, "skey"), ["skey"], "quota")
    quotas = quotas.select("skey", "shard", "blocks", "quota", (digest_number(F.lit(seed), F.lit("start"), F.col("unit")) % F.greatest("blocks", F.lit(1))).alias("start"))
    stream = W.partitionBy("skey", "shard").orderBy("turn", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = dealt.withColumn("upto", F.sum("size").over(stream)).join(quotas, ["skey", "shard"])
    taken = F.expr(_taken_before("upto", block_tokens) + " - " + _taken_before("(upto - size)", block_tokens)).cast("long")
    out = placed.select("doc_id", "source", "size", "source_size", "target", "quota", taken.alias("taken"), taken_spans(block_tokens).alias("spans"), *(["_text"] if with_text else []))
    return out.withColumn("text", mixed_text(F.col("_text"), F.col("spans"))).drop("_text") if with_text else out


def taken_spans(block: int) -> Column:
    """start, stop, times of every part of a block in a document that ends at ``upto``; only those that are taken."""
    n, begin = F.greatest("blocks", F.lit(1)), F.col("upto") - F.col("size")
    div = lambda a, b: F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))
    count = lambda j: div(j * (F.col("quota") % n) + F.col("start"), n)

    def part(j: Column) -> Column:
        return F.struct((F.greatest(j * block, begin) - begin).cast("long").alias("start"), (F.least((j + 1) * block, F.col("upto")) - begin).cast("long").alias("stop"),
                        (div(F.col("quota"), n) + count(j + 1) - count(j)).cast("long").alias("times"))

    blocks = F.sequence(div(begin, block), div(F.col("upto") - 1, block))
    none = F.array().cast("array<struct<start:bigint,stop:bigint,times:bigint>>")
    return F.when(F.col("size") > 0, F.filter(F.transform(blocks, part), lambda s: s["times"] > 0)).otherwise(none)


def mixed_text(text: Column, spans: Column) -> Column:
    """The words of the spans in order, each span as often as it is taken, with the white space that follows each word."""
    whole = F.concat(F.regexp_replace(F.coalesce(text, F.lit("")), f"^[{SPACE}]+", ""), F.lit(" "))
    words = F.split(whole, f"(?<=[{SPACE}])(?=[^{SPACE}])")
    # the outer transform binds the words, so that they are split once and not for every span
    parts = F.flatten(F.transform(F.array(words), lambda w: F.transform(spans, lambda s: F.repeat(F.array_join(F.slice(w, (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int")), ""), s["times"].cast("int")))))
    return F.regexp_replace(F.array_join(parts, ""), f"[{SPACE}]+$", "")


def _taken_before(x: str, block: int) -> str:
    """Words taken before place ``x`` of a shard's stream: whole rounds, whole chosen blocks, part of one."""
    count = lambda j: f"((({j}) * (quota % greatest(blocks, 1)) + start) div greatest(blocks, 1))"
    j = f"({x} div {block})"
    return f"((quota div greatest(blocks, 1)) * {x} + {block} * {count(j)} + ({x} % {block}) * ({count(j + ' + 1')} - {count(j)}))"
