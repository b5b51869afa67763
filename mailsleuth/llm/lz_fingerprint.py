"""Lempel-Ziv phrase fingerprints.

A text is parsed from left to right into dictionary phrases (LZ78): the longest phrase seen so far and one symbol
more become a new phrase. Symbols are the text's pieces between white space; pieces of more than ``PIECE`` bytes are
cut every ``PIECE`` bytes and every wide sign (three bytes of UTF-8 from U+3000 on) is a symbol of its own, so that
text without blanks has phrases too. The fingerprint holds the ``SKETCH`` smallest hashes of the phrase set; two
fingerprints are compared by the share of common hashes among the smallest of both, which estimates the Jaccard
similarity of the phrase sets: texts that compress each other well share phrases.

``fingerprint_edits`` compares every text with an edited form of itself, whose last third is replaced by the start
of the next document in descending id order (after the last comes the first), and with that next document. Range
partitions hold neighbours together; only one row per partition border is paired apart.

Defined results: null is the empty text; a text of white space only has the empty fingerprint; two empty
fingerprints are alike (1), an empty and another one are not (0); rows of one id, and null ids, which come last,
stand in the order of their texts' digests; a single document is its own next; an empty table gives no rows;
further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from .wordhash import MASK, WordHasher, mix

SKETCH, PIECE, SLICE_CHARS = 128, 24, 1 << 19
RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
_CHAIN = 0xD6E8FEB86659FD93


def piece_bytes() -> np.ndarray:
    """Every byte stands for itself, white space and 0 for the end of a piece."""
    table = np.arange(256, dtype=np.uint8)
    table[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
    return table


class Symbols(WordHasher):
    """Hashes of the symbols of texts."""

    def __init__(self):
        super().__init__(piece_bytes())

    def edges(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, end = super().edges(data)
        wide = np.flatnonzero(data >= 0xE3)
        if len(wide):
            inner = np.setdiff1d(wide, start, assume_unique=True)
            start, end = np.sort(np.concatenate([start, inner])), np.sort(np.concatenate([end, inner]))
        parts = (end - start + PIECE - 1) // PIECE
        if len(parts) and parts.max() > 1:
            step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            start, end = np.repeat(start, parts) + step * PIECE, np.repeat(end, parts)
            end = np.minimum(end, start + PIECE)
        return start, end


def extend(symbols: list[int], seen: set[int], phrase: int) -> int:
    """Parse on; ``seen`` gets the new phrases. Returns the phrase that is still open."""
    for s in symbols:
        phrase = (phrase * _CHAIN + s) & MASK
        if phrase not in seen:
            seen.add(phrase)
            phrase = 0
    return phrase


def sketch(seen: set[int]) -> np.ndarray:
    """The smallest 32-bit hashes of the phrases, sorted, each once."""
    hashes = np.unique((mix(np.fromiter(seen, np.uint64, len(seen))) >> np.uint64(32)).astype(np.uint32))
    return hashes[:SKETCH]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if len(a) == 0 or len(b) == 0:
        return float(len(a) == len(b))
    both = np.union1d(a, b)[:SKETCH]
    return len(np.intersect1d(np.intersect1d(a, b, assume_unique=True), both, assume_unique=True)) / len(both)


def as_text(s: np.ndarray) -> str:
    return s.astype(">u4").tobytes().hex()


def judge_pairs(hasher: Symbols, texts: list[str], next_texts: list[str]) -> Iterator[tuple]:
    """For each text and its next one: n_chars, edited digest, both fingerprints, both likenesses. A next text that
    is the following text of the list is parsed once."""
    edited = [t[:len(t) - len(t) // 3] + n[:len(t) // 3] for t, n in zip(texts, next_texts, strict=True)]
    extra = [n for i, n in enumerate(next_texts) if i + 1 == len(texts) or n is not texts[i + 1]]
    whole = [*texts, *edited, *extra]
    raw = [t.encode("utf-8", "surrogatepass") for t in whole]
    hashes, places = hasher.words(raw)
    symbols = [hashes[places[i]:places[i + 1]] for i in range(len(whole))]
    own, forms = [], []
    for i in range(len(texts)):
        a, b = symbols[i], symbols[len(texts) + i]
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        common = int(differ[0]) if len(differ) else n
        seen: set[int] = set()
        phrase = extend(a[:common].tolist(), seen, 0)
        other = seen.copy()
        extend(a[common:].tolist(), seen, phrase)
        extend(b[common:].tolist(), other, phrase)
        own.append(sketch(seen))
        forms.append(sketch(other))
    rest = []
    for i in range(len(extra)):
        seen = set()
        extend(symbols[2 * len(texts) + i].tolist(), seen, 0)
        rest.append(sketch(seen))
    used = iter(rest)
    for i in range(len(texts)):
        after = next(used) if i + 1 == len(texts) or next_texts[i] is not texts[i + 1] else own[i + 1]
        yield (len(texts[i]), hashlib.sha256(raw[len(texts) + i]).hexdigest(), as_text(own[i]), as_text(forms[i]), likeness(own[i], forms[i]), likeness(own[i], after))


def pair_slices(pairs: Iterator[tuple[int | None, str, str]]) -> Iterator[pa.RecordBatch]:
    hasher, ids, texts, after, size = Symbols(), [], [], [], 0

    def result():
        columns = list(zip(*judge_pairs(hasher, texts, after), strict=True))
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        arrays = [pa.array(ids, pa.int64()), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    for doc_id, text, following in pairs:
        ids.append(doc_id)
        texts.append(text)
        after.append(following)
        size += len(text)
        if size > SLICE_CHARS:
            yield result()
            ids, texts, after, size = [], [], [], 0
    if ids:
        yield result()


def rows_of(batches) -> Iterator[tuple[int | None, str]]:
    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            part = batch.slice(low, 256)
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                yield doc_id, text or ""


def inner_pairs(batches):
    """Every row of a partition but the last one, with the row that follows."""
    def pairs():
        before = None
        for row in rows_of(batches):
            if before is not None:
                yield (*before, row[1])
            before = row
    yield from pair_slices(pairs())


def borders(batches):
    """One row: the first and the last row of the partition."""
    first = last = None
    for batch in batches:
        if batch.num_rows:
            first = batch.slice(0, 1) if first is None else first
            last = batch.slice(batch.num_rows - 1, 1)
    if first is not None:
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), first.column("text"), last.column("doc_id"), last.column("text")],
                                         names=["part", "first_text", "doc_id", "text"])


def border_pairs(batches):
    def pairs():
        for batch in batches:
            for doc_id, text, following in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "next_text")], strict=True):
                yield doc_id, text or "", following or ""
    yield from pair_slices(pairs())


def fingerprint_edits(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """``docs``: doc_id, text. One row per document, as the module says."""
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(n, *order).sortWithinPartitions(*order)
    inside = ranged.mapInArrow(inner_pairs, RESULT)
    ends = ranged.mapInArrow(borders, "part long, first_text string, doc_id long, text string")
    turn = W.partitionBy(F.lit(0)).orderBy("part")  # one row per partition
    start = F.first("first_text").over(turn.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    met = ends.select("doc_id", "text", F.coalesce(F.lead("first_text").over(turn), start).alias("next_text"))
    return inside.unionByName(met.mapInArrow(border_pairs, RESULT))
