"""N-gram Jaccard join by banded MinHash: an LSH forest whose depth is fixed beforehand for all sets, not adapted to each.

1. A document is the set of its word shingles (runs of ``width`` words; of all its words if it has fewer). Documents
   of one set are copies and go on as one.
2. Each of ``trees`` bands holds the sets under labels of d minimum hashes. A pair of similarity s shares a label with
   probability s**d, and meets in one of the bands with 1 - (1 - s**d)**trees. d is the largest number up to
   ``longest`` for which that is at least ``target`` for pairs at the threshold; then it is more for all others. There
   are no tries, and no set looks at longer prefixes first. Sets under one label are found by grouping.
3. Runs that share a set form candidate components. In a component every pair is compared exactly on its shingles,
   so links inside one are never missed. A component of at most ``block`` sets is one group. A larger one is dealt to
   blocks by size band (sets whose sizes differ by more than the threshold allows cannot be similar) and digest, and
   every pair of blocks of equal or neighbouring bands is a group: no group holds more than about two blocks.
4. Groups give counts of links and one edge per linked set to a root, never the pairs themselves; the roots' components are
   the classes.

Results: ``class_id`` (smallest doc_id of the class) and ``n_links``, the number of other documents whose similarity
to this one is at least ``threshold``, copies counted. Defined results: a document without words (null, empty, signs
only) is linked to documents of exactly the same text only, null being a text of its own; repeated rows are
documents of their own, so each has the other as a link; null ids count last, and a class of null ids only has a null
class_id; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.components import components
from .common import Bloom, content_key, small_batches, stored
from .wordhash import WordHasher, mix, shingles, slices

WIDTH, THRESHOLD, TREES, LONGEST, TARGET, BLOCK = 5, 0.8, 16, 8, 0.999, 256


def prefix_length(trees: int = TREES, threshold: float = THRESHOLD, longest: int = LONGEST, target: float = TARGET) -> int:
    """Longest prefix that reaches the target recall at the threshold; 1 at least."""
    for d in range(longest, 1, -1):
        if 1 - (1 - threshold ** d) ** trees >= target:
            return d
    return 1


def label_hashes(found: np.ndarray, first: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """For each text with shingles, the hash of its label prefix in each tree."""
    own = np.flatnonzero(np.diff(first) > 0)
    rng = np.random.default_rng(17)
    a, b = rng.integers(1, 1 << 63, (2, trees, depth), dtype=np.uint64)
    out = np.zeros((len(own), trees), np.uint64)
    for t in range(trees):
        label = np.full(len(own), t + 1, np.uint64)
        for d in range(depth):
            least = np.minimum.reduceat(found * (a[t, d] | np.uint64(1)) + b[t, d], first[own])
            label = mix(label * np.uint64(0x9E3779B97F4A7C15) + least)
        out[:, t] = label
    return out


def signatures(docs: DataFrame, doc_id: str, text: str, width: int, trees: int, depth: int) -> DataFrame:
    """Stored: doc_id, _id (as text), _key (of the text), digest (of the set), size, labels."""
    def sign(batches):
        hasher = WordHasher()
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("_key").to_pylist()
            for begin, own in slices(batch.column("text")):
                found, first = shingles(*hasher.words(own), width)
                labels = iter(label_hashes(found, first, trees, depth).astype(np.int64) if len(found) else ())
                digests, sizes, marks = [], [], []
                for i in range(len(own)):
                    held = np.unique(found[first[i]:first[i + 1]])
                    digests.append(hashlib.blake2b(held.tobytes(), digest_size=16).hexdigest() if len(held) else "text" + keys[begin + i])
                    sizes.append(len(held))
                    marks.append(next(labels) if len(held) else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([ids.slice(begin, len(own)), pa.array(keys[begin:begin + len(own)], pa.string()), pa.array(digests, pa.string()), pa.array(sizes, pa.int64()), pa.array(marks, pa.list_(pa.int64()))],
                                                 names=["doc_id", "_key", "digest", "size", "labels"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), content_key(F.col(text)).alias("_key"), F.col(text).alias("text"))
    signed = rows.mapInArrow(sign, "doc_id long, _key string, digest string, size long, labels array<long>")
    return stored(signed.withColumn("_id", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), "signatures")


def similar(sets: list[np.ndarray], side: np.ndarray, threshold: float) -> np.ndarray:
    """Matrix of the links of a group: pairs at or over the threshold. Sides are 0 in the group of a block with
    itself; in a group of two blocks, of which one may be empty, they are 1 and 2, and only pairs of both count."""
    n, size = len(sets), np.array([len(s) for s in sets], np.float64)
    everything, owner = np.concatenate(sets), np.repeat(np.arange(n), size.astype(np.int64))
    _, at, count = np.unique(everything, return_inverse=True, return_counts=True)
    shared = count[at] > 1
    place = np.cumsum(count > 1) - 1
    at, owner = place[at[shared]], owner[shared]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    common = np.zeros((n, n), np.float32)
    step = 8192
    for low in range(0, int(at[-1]) + 1 if len(at) else 0, step):
        i, j = np.searchsorted(at, (low, low + step))
        held = np.zeros((n, step), np.float32)
        held[owner[i:j], at[i:j] - low] = 1
        common += held @ held.T
    linked = common >= threshold * (size[:, None] + size[None, :] - common) - 1e-6
    np.fill_diagonal(linked, False)
    return linked & (side[:, None] != side[None, :]) if side.any() else linked


def local_roots(linked: np.ndarray) -> np.ndarray:
    """Smallest member of each member's component."""
    root = np.arange(len(linked))
    while True:
        least = np.minimum(root, np.where(linked, root[None, :], len(root)).min(axis=1))
        least = least[least]
        if (least == root).all():
            return root
        root = least


def verify_groups(width: int, threshold: float):
    """Mapper over rows sorted by group: set_id, links and root of every linked set."""
    def verify(batches):
        hasher = WordHasher()
        out = {"set_id": [], "links": [], "root": []}

        def flush(rows):
            texts = [r["text"] for r in rows]
            sets = []
            for _, own in slices(texts):
                found, first = shingles(*hasher.words(own), width)
                sets += [np.unique(found[first[i]:first[i + 1]]) for i in range(len(own))]
            begin = 0
            while begin < len(rows):
                end = begin
                while end < len(rows) and group(rows[end]) == group(rows[begin]):
                    end += 1
                keep = [i for i in range(begin, end) if i == begin or rows[i]["set_id"] != rows[i - 1]["set_id"]]
                ids = np.array([rows[i]["set_id"] for i in keep], np.int64)
                linked = similar([sets[i] for i in keep], np.array([rows[i]["side"] for i in keep]), threshold)
                links, root = linked @ np.array([rows[i]["copies"] for i in keep], np.int64), local_roots(linked)
                for i in np.flatnonzero(linked.any(axis=1)):
                    out["set_id"].append(int(ids[i]))
                    out["links"].append(int(links[i]))
                    out["root"].append(int(ids[root[i]]))
                begin = end

        def group(row):
            return row["comp"], row["x"], row["y"]

        rows, size = [], 0
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                for row in batch.slice(low, 512).to_pylist():
                    if rows and size > 1 << 20 and group(row) != group(rows[-1]):
                        flush(rows)
                        rows, size = [], 0
                    rows.append(row)
                    size += len(row["text"] or "")
        if rows:
            flush(rows)
        yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in out.items()})

    return verify


def candidate_groups(sets: DataFrame, threshold: float, block: int) -> DataFrame:
    """set_id, _id, _key, copies, comp, x, y, side for every group a candidate set belongs to; stored."""
    entries = sets.select("set_id", F.explode("labels").alias("label"))
    runs = entries.groupBy("label").agg(F.min("set_id").alias("low"), F.max("set_id").alias("high")).where("low < high").select("label", "low")
    met = stored(entries.join(runs, "label").select("set_id", "low"), "trie-runs")
    roots = components(met.where("set_id <> low").select(F.col("set_id").alias("a"), F.col("low").alias("b")), "candidate-components")
    members = stored(met.select("set_id").distinct().join(roots, F.col("set_id") == F.col("v"), "left")
                     .select("set_id", F.coalesce("root", "set_id").alias("comp"))
                     .join(sets.select("set_id", "size", "rep", "copies"), "set_id"), "candidates")
    # small sides are stored, so that both sides of each join are plain scans and Spark can split a large component
    sizes = stored(members.groupBy("comp").agg(F.count("*").alias("n")), "component-sizes")
    band = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(1 / threshold)))
    dealt = stored(members.join(sizes, "comp").withColumn("band", F.when(F.col("n") <= block, F.lit(0)).otherwise(band).cast("long")), "banded")
    bands = dealt.groupBy("comp", "band").agg(F.count("*").alias("m")).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("m") * 2 / block)).cast("int"))
    bands = stored(bands.withColumn("parts", F.when(F.col("m") <= block, F.lit(1)).otherwise(F.col("parts"))), "bands")
    dealt = stored(dealt.join(bands.select("comp", "band", "parts"), ["comp", "band"]), "dealt")
    own = F.concat_ws(":", F.lpad(F.col("band").cast("string"), 4, "0"), F.lpad(F.pmod(F.xxhash64("set_id"), F.col("parts")).cast("string"), 8, "0"))
    around = bands.select("comp", F.col("band").alias("other_band"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1).alias("near"))
    around = around.select("comp", F.explode("near").alias("band"), F.concat_ws(":", F.lpad(F.col("other_band").cast("string"), 4, "0"), F.lpad(F.col("part").cast("string"), 8, "0")).alias("other"))
    groups = dealt.withColumn("own", own).join(stored(around, "block-pairs"), ["comp", "band"])
    return stored(groups.select("set_id", F.col("rep._id").alias("_id"), F.col("rep._key").alias("_key"), "copies", "comp", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"),
                                F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side")), "groups")


def link_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, threshold: float = THRESHOLD,
                   trees: int = TREES, longest: int = LONGEST, target: float = TARGET, block: int = BLOCK) -> DataFrame:
    """doc_id, _id, _key, class_id, n_links, keep (of one row key per class) of every document."""
    signed = signatures(docs, doc_id, text, width, trees, prefix_length(trees, threshold, longest, target))
    sets = signed.groupBy("digest").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_id", "_key")).alias("rep"),
                                        F.first("size").alias("size"), F.first("labels").alias("labels"))
    sets = stored(sets.withColumn("set_id", F.monotonically_increasing_id()), "sets")
    groups = candidate_groups(sets, threshold, block)
    bloom = Bloom(groups.select(F.xxhash64("_id", "_key").alias("h")).distinct(), "h")
    texts = docs.select(F.coalesce(F.col(doc_id).cast("long").cast("string"), F.lit("")).alias("_id"), content_key(F.col(text)).alias("_key"), F.col(text).alias("text"))
    texts = texts.where(bloom.may_hold(F.xxhash64("_id", "_key")))
    rows = texts.join(groups, ["_id", "_key"]).select("comp", "x", "y", "side", "set_id", "copies", "text")
    rows = rows.repartition("comp", "x", "y").sortWithinPartitions("comp", "x", "y", "set_id")
    linked = stored(rows.mapInArrow(verify_groups(width, threshold), "set_id long, links long, root long"), "links")
    links = linked.groupBy("set_id").agg(F.sum("links").alias("links"))
    roots = components(linked.select(F.col("set_id").alias("a"), F.col("root").alias("b")), "classes")
    info = (sets.select("set_id", "digest", "copies", "rep").join(links, "set_id", "left").join(roots.withColumnRenamed("v", "set_id"), "set_id", "left")
            .select("digest", "rep", F.coalesce("root", "set_id").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    info = stored(info, "set-links")
    classes = info.groupBy("root").agg(F.min("rep").alias("best"))
    info = stored(info.join(classes, "root").select("digest", "n_links", F.col("best.doc_id").alias("class_id"), F.col("best._id").alias("best_id"), F.col("best._key").alias("best_key")), "set-classes")
    out = signed.select("doc_id", "_id", "_key", "digest").join(info, "digest")
    return out.select("doc_id", "_id", "_key", "class_id", "n_links", ((F.col("_id") == F.col("best_id")) & (F.col("_key") == F.col("best_key"))).alias("keep"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each class: the one with the smallest id. Only texts that a Bloom filter of the rows to drop, or
    to keep once of several, lets through are joined; all others pass as they are."""
    linked = stored(link_documents(docs, doc_id, text, **options), "dedup-decisions")
    drop = linked.where("not keep").select("_id", "_key").distinct()
    again = linked.where("keep").groupBy("_id", "_key").agg(F.count("*").alias("n")).where("n > 1").select("_id", "_key")
    bloom = Bloom(drop.unionByName(again).select(F.xxhash64("_id", "_key").alias("h")), "h")
    rows = docs.withColumns({"_id": F.coalesce(F.col(doc_id).cast("long").cast("string"), F.lit("")), "_key": content_key(F.col(text))})
    rows = rows.withColumn("_hit", bloom.may_hold(F.xxhash64("_id", "_key")))
    hits = rows.where("_hit").join(drop, ["_id", "_key"], "left_anti").dropDuplicates(["_id", "_key"])
    return rows.where("not _hit").select(*docs.columns).unionByName(hits.select(*docs.columns))
