"""Near duplicates by circulant MinHash: banded candidates, confirmed on whole shingle sets.

1. A word is a run of other characters than blank and tab to carriage return, A-Z lower-cased. A document is the set of
   its distinct runs of ``width`` words, of the whole sequence if it has fewer. Documents of one set go on as one.
2. Two permutations of the 2**32 places give all coordinates of a signature: the first scatters the shingles, and
   coordinate k is the smallest value that the second, shifted round by k places, has at any of them. ``rows`` coordinates
   make a band; a pair of similarity s shares one of ``bands`` bands with probability 1 - (1 - s**rows)**bands, which is
   0.999997 for 42 bands of 6 at 0.8.
3. Sets under one band label are a bucket. Its hub is the member with the most neighbours over all its buckets, so that
   the centre of a family of copies is hub of nearly all its buckets. Every member is compared exactly with its hubs:
   a bucket is settled by as many comparisons as it has members if these links leave one class in it.
4. Buckets whose other members still are of several classes are joined into candidate components and compared pair by
   pair there, in blocks dealt over tasks, so that no link between two texts of a bucket is lost.
5. Classes are the components of the confirmed links; no pairs but those with hubs and roots are ever rows.

Defined results: a null or wordless text has no shingles, is linked with nothing and kept. Repeated rows are documents
of their own. Null ids count last: a component of null ids only has a null component_id, and its rows are kept; in
another component they are not. An empty table gives no rows; further columns are not read. ``doc_id`` must be a whole
number. A very long text is hashed in pieces cut at word ends; only its shingle hashes are held at once.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.components import components
from .common import Bloom, content_key, small_batches, stored
from .ngram_join import candidate_groups, local_roots, similar
from .wordhash import SLICE_BYTES, WordHasher, mix, shingles, slices

WIDTH, PERCENT, BANDS, ROWS, BLOCK, SHARE = 4, 80, 42, 6, 256, 512
# permutations: odd multipliers and shifts of each round, and an offset
SCATTER, VALUES, OFFSET = ((0x9E3779B1, 15), (0x85EBCA77, 13)), ((0xC2B2AE3D, 15), (0x27D4EB2F, 13), (0x165667B1, 16)), 0x2545F491
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def space_words() -> np.ndarray:
    """Byte to itself, lower-cased, or 0 for white space. 0 stands between texts, so a NUL of a text comes as 0xFF."""
    table = np.arange(256, dtype=np.uint8)
    table[ord("A"):ord("Z") + 1] += 32
    table[[0x20, *range(0x09, 0x0E)]] = 0
    return table


class ShingleSets:
    """Hashed shingles of texts, kept tables included."""

    def __init__(self, width: int = WIDTH):
        self.hasher, self.width = WordHasher(space_words()), width

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [t.replace(b"\x00", b"\xff") for t in texts]
        if len(texts) > 1 or len(texts[0]) <= SLICE_BYTES:
            return self.hasher.words(texts)
        found, begin, text = [], 0, texts[0]
        while begin < len(text):
            cut = SPACE.search(text, min(len(text), begin + SLICE_BYTES))
            end = cut.start() if cut else len(text)
            found.append(self.hasher.words([text[begin:end]])[0])
            begin = end + 1
        words = np.concatenate(found)
        return words, np.array([0, len(words)])

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return shingles(*self.words(texts), self.width)

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        found, first = self.of(texts)
        return [np.unique(found[first[i]:first[i + 1]]) for i in range(len(texts))]


def permuted(x: np.ndarray, rounds: tuple, scratch: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit numbers, in place; every round is one: an odd multiple and a shifted sum."""
    for factor, shift in rounds:
        x *= np.uint32(factor)
        np.right_shift(x, np.uint32(shift), out=scratch)
        x ^= scratch
    return x


def circulant_signatures(found: np.ndarray, first: np.ndarray, length: int) -> np.ndarray:
    """Signature of each text with shingles: coordinate k is the least value of the second permutation, shifted by k."""
    own = np.flatnonzero(np.diff(first) > 0)
    out = np.empty((len(own), length), np.uint32)
    place, scratch, value = (found >> np.uint64(32)).astype(np.uint32), np.empty(len(found), np.uint32), np.empty(len(found), np.uint32)
    place += np.uint32(OFFSET)
    permuted(place, SCATTER, scratch)
    for k in range(length):
        np.subtract(place, np.uint32(k), out=value)
        out[:, k] = np.minimum.reduceat(permuted(value, VALUES, scratch), first[own])
    return out


def band_labels(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    labels = np.empty((len(signatures), bands), np.uint64)
    for b in range(bands):
        label = np.full(len(signatures), b + 1, np.uint64)
        for r in range(b * rows, (b + 1) * rows):
            label = mix(label * np.uint64(0x9E3779B97F4A7C15) + signatures[:, r])
        labels[:, b] = label
    return labels.astype(np.int64)


def sign_documents(docs: DataFrame, doc_id: str, text: str, width: int, bands: int, rows: int) -> DataFrame:
    """Stored: doc_id, _id (as text), _key (of the text), digest (of the set; null without shingles), size, labels."""
    def sign(batches):
        shingled = ShingleSets(width)
        for batch in batches:
            for begin, own in slices(batch.column("text")):
                found, first = shingled.of(own)
                labels = iter(band_labels(circulant_signatures(found, first, bands * rows), bands, rows) if len(found) else ())
                held = [np.unique(found[first[i]:first[i + 1]]) for i in range(len(own))]
                columns = [batch.column(c).slice(begin, len(own)) for c in ("doc_id", "_key")]
                columns += [pa.array([hashlib.blake2b(h.tobytes(), digest_size=16).hexdigest() if len(h) else None for h in held], pa.string()), pa.array([len(h) for h in held], pa.int64()),
                            pa.array([next(labels) if len(h) else np.zeros(0, np.int64) for h in held], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "_key", "digest", "size", "labels"])

    small_batches(docs.sparkSession)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), content_key(F.col(text)).alias("_key"), F.col(text).alias("text"))
    signed = texts.mapInArrow(sign, "doc_id long, _key string, digest string, size long, labels array<long>")
    return stored(signed.withColumn("_id", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), "circulant-signatures")


def distinct_sets(signed: DataFrame) -> DataFrame:
    """Stored: set_id, digest, first_id, rep (a row that holds the set), copies, size, labels."""
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_id", "_key"))
    sets = signed.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first_id"), rep.alias("rep"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("labels").alias("labels"))
    return stored(sets.withColumn("set_id", F.monotonically_increasing_id()), "shingle-sets")


def bucket_members(sets: DataFrame) -> DataFrame:
    """Stored: label, set_id, size of every member of a bucket of several sets, and the bucket's hub and its size. Both
    sides of each join are scans of stored tables or of their rows, so that Spark can split a common label."""
    entries = sets.select(F.explode("labels").alias("label"), "set_id", "size")
    counts = stored(entries.groupBy("label").agg(F.count("*").alias("n")).where("n > 1"), "bucket-sizes")
    met = stored(entries.join(counts, "label"), "bucket-entries")
    known = stored(met.groupBy("set_id").agg(F.sum("n").alias("around")), "set-neighbours")
    hubs = met.join(known, "set_id").groupBy("label").agg(F.max(F.struct("around", "set_id", "size")).alias("h"))
    hubs = stored(hubs.select("label", F.col("h.set_id").alias("hub"), F.col("h.size").alias("hub_size")), "bucket-hubs")
    return stored(met.select("label", "set_id", "size").join(hubs, "label"), "buckets")


def confirm_with_hubs(width: int, percent: int):
    """Mapper over rows sorted by hub, share and role, the hub's own row first: linked members with their hub."""
    def confirm(batches):
        shingled, now, held = ShingleSets(width), None, None
        for batch in batches:
            hub, part, of = (batch.column(c).to_pylist() for c in ("hub", "share", "set_id"))
            for begin, own in slices(batch.column("text")):
                out = []
                for i, found in enumerate(shingled.sets(own), begin):
                    if (hub[i], part[i]) != now:
                        now, held = (hub[i], part[i]), found
                        continue
                    common = np.intersect1d(held, found, assume_unique=True).size
                    if 100 * common >= percent * (len(held) + len(found) - common):
                        out.append(i)
                yield pa.RecordBatch.from_pydict({"a": pa.array([of[i] for i in out], pa.int64()), "b": pa.array([hub[i] for i in out], pa.int64())})

    return confirm


def hub_links(buckets: DataFrame, texts: DataFrame, width: int, percent: int, share: int) -> DataFrame:
    """Stored: a, b for each set whose similarity to a hub of one of its buckets is confirmed. The members of a hub are
    dealt to shares of about ``share``; each share gets the hub's text once."""
    near = F.least("size", "hub_size") * 100 >= F.greatest("size", "hub_size") * percent
    pairs = stored(buckets.where(near & (F.col("set_id") != F.col("hub"))).select("hub", "set_id").distinct(), "hub-pairs")
    shares = stored(pairs.groupBy("hub").agg(F.ceil(F.count("*") / share).cast("int").alias("shares")), "hub-shares")
    members = pairs.join(shares, "hub").select("hub", F.pmod(F.xxhash64("set_id"), F.col("shares")).cast("int").alias("share"), "set_id", F.lit(1).alias("role"))
    own = shares.select("hub", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.col("hub").alias("set_id"), F.lit(0).alias("role"))
    rows = stored(members.unionByName(own), "hub-groups").join(texts, "set_id")
    rows = rows.repartition("hub", "share").sortWithinPartitions("hub", "share", "role", "set_id").select("hub", "share", "set_id", "text")
    return stored(rows.mapInArrow(confirm_with_hubs(width, percent), "a long, b long"), "hub-links")


def compare_groups(width: int, percent: int):
    """Mapper over rows sorted by group (comp, x, y): every linked set with a root of it in the group. A group is at
    most two blocks, and the only rows held."""
    def compare(batches):
        shingled, rows, now = ShingleSets(width), [], None

        def settle():
            keep = [i for i in range(len(rows)) if i == 0 or rows[i][0] != rows[i - 1][0]]
            linked = similar([rows[i][2] for i in keep], np.array([rows[i][1] for i in keep]), percent / 100)
            root, some = local_roots(linked), np.flatnonzero(linked.any(axis=1))
            return pa.RecordBatch.from_pydict({"a": pa.array([rows[keep[i]][0] for i in some], pa.int64()), "b": pa.array([rows[keep[root[i]]][0] for i in some], pa.int64())})

        for batch in batches:
            groups = list(zip(*(batch.column(c).to_pylist() for c in ("comp", "x", "y")), strict=True))
            of, side = batch.column("set_id").to_pylist(), batch.column("side").to_pylist()
            for begin, own in slices(batch.column("text")):
                for i, found in enumerate(shingled.sets(own), begin):
                    if groups[i] != now and rows:
                        yield settle()
                        rows.clear()
                    now = groups[i]
                    rows.append((of[i], side[i], found))
        if rows:
            yield settle()

    return compare


def block_links(buckets: DataFrame, sets: DataFrame, classes: DataFrame, texts: DataFrame, width: int, percent: int, block: int) -> DataFrame:
    """Stored: a, b for the links among the members other than the hub, of buckets where these are of several classes."""
    others = buckets.where("set_id <> hub").select("label", "set_id")
    known = others.join(classes, F.col("set_id") == F.col("v"), "left").select("label", "set_id", F.coalesce("root", "set_id").alias("class"))
    unsettled = stored(known.groupBy("label").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select("label"), "unsettled-buckets")
    rest = others.join(unsettled, "label").groupBy("set_id").agg(F.collect_list("label").alias("labels"))  # bands at most
    rest = stored(rest.join(sets.drop("labels"), "set_id"), "unsettled-sets")
    groups = candidate_groups(rest, percent / 100, block)
    rows = groups.select("comp", "x", "y", "set_id", "side").join(texts, "set_id").repartition("comp", "x", "y").sortWithinPartitions("comp", "x", "y", "set_id")
    return stored(rows.mapInArrow(compare_groups(width, percent), "a long, b long"), "block-links")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT,
                    bands: int = BANDS, rows: int = ROWS, block: int = BLOCK, share: int = SHARE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    signed = sign_documents(docs, doc_id, text, width, bands, rows)
    sets = distinct_sets(signed)
    buckets = bucket_members(sets)
    wanted = stored(buckets.select("set_id").distinct().join(sets.select("set_id", "rep"), "set_id").select("set_id", "rep._id", "rep._key"), "candidate-sets")
    bloom = Bloom(wanted.select(F.xxhash64("_id", "_key").alias("h")), "h")
    source = docs.select(F.coalesce(F.col(doc_id).cast("long").cast("string"), F.lit("")).alias("_id"), content_key(F.col(text)).alias("_key"), F.col(text).alias("text"))
    source = source.where(bloom.may_hold(F.xxhash64("_id", "_key"))).join(wanted, ["_id", "_key"])
    texts = stored(source.groupBy("set_id").agg(F.first("text").alias("text")), "candidate-texts")  # rows of one id and text are one
    links = hub_links(buckets, texts, width, percent, share)
    more = block_links(buckets, sets, components(links, "hub-classes"), texts, width, percent, block)
    roots = components(links.unionByName(more), "near-classes")
    of_sets = stored(sets.select("set_id", "digest", "first_id").join(roots, F.col("set_id") == F.col("v"), "left").select("digest", "first_id", F.coalesce("root", "set_id").alias("root")), "set-classes")
    least = of_sets.groupBy("root").agg(F.min("first_id").alias("component_id"))
    info = stored(of_sets.join(least, "root").select("digest", "component_id", F.lit(True).alias("known")), "set-components")
    out = signed.select("doc_id", "size", "digest").join(info, "digest", "left")
    component = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
