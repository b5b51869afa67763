"""License scan: an exact set-similarity join of text blocks with license templates.

A block is a line of a text, a template a set of words. A block matches a template if it holds at least
``threshold`` of the template's words. Template words are ordered by the number of documents that hold them, rarest
first; a matching block must hold one of the template's first ``|T| - ceil(threshold |T|) + 1`` words (prefix
filter), and enough template words must be left from that word on (positional filter) and in the block as a whole
(length filter). What passes is compared exactly. Beside that, phrases with labels of their own are located word by word.

Documents are tokenised once: a stored row per document keeps its word count, its phrase places and, of lines
with enough template words, those words. Matches are joined back by the digest of the text.

Defined results: null is the empty text, without words, labels or places, with score 0; equally frequent words are
ordered by the word; an empty table gives no rows; repeated rows each get their result; further columns of ``docs``
stay, except those named like a result, which are replaced. Templates and phrases are short literal parameters.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import NOT_WORD, ascii_lower, content_key, stored

PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit-notice", "released under the mit license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("proprietary", "all rights reserved"),
]
THRESHOLD = 0.8
RESULTS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def template_words(text: str) -> list[str]:
    return sorted(set(re.sub(NOT_WORD, " ", text.lower()).split()))


def needed(size: int, threshold: float) -> int:
    """Least number of common words."""
    return max(1, math.ceil(threshold * size - 1e-9))


def phrase_places(words: Column, phrase: str) -> Column:
    """Places (from 0) where the phrase's words stand one after the other."""
    parts = phrase.split(" ")
    last = F.size(words) - len(parts)

    def here(i: Column) -> Column:
        hit = F.lit(True)
        for k, part in enumerate(parts):
            hit = hit & (F.get(words, i + k) == part)
        return hit

    may = F.array_contains(words, parts[0]) & (last >= 0)
    return F.when(may, F.filter(F.sequence(F.lit(0), last), here)).otherwise(F.array().cast("array<int>"))


def template_table(spark: SparkSession, templates: list[tuple[str, str]], threshold: float) -> DataFrame:
    """label, words, size, needed, word: one row per template and word."""
    rows = [(label, own, len(own), needed(len(own), threshold), word) for label, text in templates for own in [template_words(text)] for word in own]
    return spark.createDataFrame(rows, "label string, words array<string>, size int, needed int, word string")


def scan_blocks(docs: DataFrame, text: str, templates: list[tuple[str, str]], phrases: list[tuple[str, str]], threshold: float) -> DataFrame:
    """One stored row per document: _key, n_words, _p0.. (places of each phrase), _held (template words of the whole
    text), _blocks (template words of each line that has enough)."""
    vocabulary = sorted({w for _, t in templates for w in template_words(t)})
    least = min((needed(len(template_words(t)), threshold) for _, t in templates), default=1)
    lines = F.split(F.coalesce(ascii_lower(F.col(text)), F.lit("")), "\n")
    rows = docs.withColumns({"_key": content_key(F.col(text)), "_lines": F.transform(lines, lambda line: F.array_remove(F.split(line, NOT_WORD), ""))}).drop(text)
    rows = rows.withColumns({"_w": F.flatten("_lines"), "_known": F.array(*[F.lit(w) for w in vocabulary])})
    held = F.filter(F.transform("_lines", lambda line: F.array_intersect(line, F.col("_known"))), lambda b: F.size(b) >= least)
    places = {f"_p{i}": phrase_places(F.col("_w"), phrase) for i, (phrase, _) in enumerate(phrases)}
    out = rows.withColumns({"n_words": F.size("_w").cast("long"), "_held": F.array_intersect("_w", "_known"), "_blocks": held, **places})
    return stored(out.drop("_lines", "_w", "_known"), "license-blocks")


def template_matches(rows: DataFrame, templates: DataFrame) -> DataFrame:
    """_key, label, score for every text and template with a matching block."""
    frequency = rows.select(F.explode("_held").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    order = W.partitionBy("label").orderBy(F.coalesce("n", F.lit(0)), "word")
    prefix = (templates.join(frequency, "word", "left").withColumn("place", F.row_number().over(order))
              .where(F.col("place") <= F.col("size") - F.col("needed") + 1))
    blocks = rows.select("_key", F.explode("_blocks").alias("block")).select("_key", "block", F.explode("block").alias("word"))
    met = blocks.join(F.broadcast(prefix), "word")  # a row per template word at most: the templates are a parameter
    met = met.where((F.size("block") >= F.col("needed")) & (F.col("size") - F.col("place") + 1 >= F.col("needed")))
    common = F.size(F.array_intersect("words", "block"))
    return met.where(common >= F.col("needed")).groupBy("_key", "label").agg(F.max(common / F.col("size")).alias("score"))


def scan_licenses(docs: DataFrame, text: str = "text", templates: list[tuple[str, str]] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the text column, with ``_key`` (digest of the text) and the columns of ``RESULTS``."""
    rows = scan_blocks(docs.drop(*RESULTS), text, templates, phrases, threshold)
    matched = template_matches(rows, template_table(docs.sparkSession, templates, threshold))
    per_text = matched.groupBy("_key").agg(F.collect_set("label").alias("_found"), F.max("score").alias("score"))
    # both sides of the join are plain scans, so that Spark can split the rows of a text with many copies
    out = rows.drop("_held", "_blocks").join(stored(per_text, "license-labels"), "_key", "left")
    every = F.concat(*[F.col(f"_p{i}") for i in range(len(phrases))])
    base = F.array_compact(F.array(*[F.when(F.size(f"_p{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(phrases)]))
    text_of = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    out = out.withColumns({
        "n_base": F.size(every).cast("long"), "first_word": F.array_min(every).cast("long"), "last_word": F.array_max(every).cast("long"),
        "base_labels": text_of(base), "labels": text_of(F.concat(base, F.coalesce("_found", F.array().cast("array<string>")))),
        "score": F.coalesce("score", F.lit(0.0))})
    return out.drop("_found", *[f"_p{i}" for i in range(len(phrases))])
