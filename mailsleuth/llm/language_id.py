"""Language by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector is the product of its three letters' vectors,
the first rolled by two places and the second by one; a text's vector is the sum over its trigrams, a language's
prototype the sum over its texts' vectors, each scaled to its number of trigrams. A text gets the language whose
prototype has the largest cosine with its vector. Letters are lower-cased; every run of other characters is one
blank, so that word ends are part of the trigrams.

Prototypes are learnt from text and language alone, of about ``train_docs`` documents drawn by a digest of id and text (a
documented bound): every language has an equal share of the places, ``LEAST_DOCS`` at least, and a language with fewer
documents is learnt whole, so each known language has its prototype at every size of the table. Rows of equal id, text
and language are learnt once. Prediction sees the text only. Defined results: null or letterless text is
``und`` with score 0; with nothing to learn from every text is ``und``; a null id is never learnt from and not held
out; repeated rows are predicted each; ties go to the language that sorts first; an empty table gives no rows;
further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import small_batches

DIMENSIONS, SEED, NONE = 1024, 20240101, "und"
BLANK = 32
SLICE_CHARS = 1 << 19
MAX_TRIGRAMS, PIECE = 24_000, 4_000
LEAST_DOCS = 200


class Trigrams:
    """Trigram counts of texts and the vectors of trigrams, kept between slices."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.d = dimensions
        self.symbol = np.fromiter((ord(c.lower()[0]) if c.isalpha() else BLANK for c in map(chr, range(0x10000))), np.int32, 0x10000)
        self.letters: dict[int, np.ndarray] = {}
        self.codes, self.at = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.vectors = np.empty((MAX_TRIGRAMS, dimensions), np.int8)

    def symbols(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        out = self.symbol[np.minimum(points, 0xFFFF)]
        for i in np.flatnonzero(points > 0xFFFF):
            out[i] = ord(chr(points[i]).lower()[0]) if chr(points[i]).isalpha() else BLANK
        return out

    def letter(self, point: int) -> np.ndarray:
        if point not in self.letters:
            self.letters[point] = (np.random.default_rng([SEED, point]).integers(0, 2, self.d) * 2 - 1).astype(np.int8)
        return self.letters[point]

    def rows(self, codes: np.ndarray) -> np.ndarray:
        """Vectors of the sorted codes, ``PIECE`` at most. The kept ones, signs in a byte each, are dropped when the table
        is full."""
        new = np.setdiff1d(codes, self.codes, assume_unique=True)
        if len(self.codes) + len(new) > MAX_TRIGRAMS:
            self.codes, self.at, new = self.codes[:0], self.at[:0], codes
        if len(new):
            begin = len(self.codes)
            for i, code in enumerate(new.tolist()):
                a, b, c = code >> 42, code >> 21 & 0x1FFFFF, code & 0x1FFFFF
                self.vectors[begin + i] = np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)
            both = np.concatenate([self.codes, new])
            order = np.argsort(both, kind="stable")
            self.codes, self.at = both[order], np.concatenate([self.at, np.arange(begin, begin + len(new))])[order]
        return self.vectors[self.at[np.searchsorted(self.codes, codes)]].astype(np.float32)

    @staticmethod
    def coded(symbols: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted codes of the trigrams that occur, and for each trigram its place among them."""
        letters, small = np.unique(symbols.astype(np.int64), return_inverse=True) if symbols.max(initial=0) > 0xFFFF else (None, None)
        if letters is None:
            letters = np.flatnonzero(np.bincount(symbols, minlength=1))
            place = np.zeros(letters.max(initial=0) + 1, np.int32 if len(letters) <= 1024 else np.int64)
            place[letters] = np.arange(len(letters))
            small = place[symbols]
        k = len(letters)
        code = (small[:-2] * (k * k) + small[1:-1] * k + small[2:])[inside]
        if k <= 160:  # so few letters that a table of all trigrams is small
            seen = np.flatnonzero(np.bincount(code, minlength=1))
            place = np.zeros(k ** 3, np.int32)
            place[seen] = np.arange(len(seen))
            at = place[code]
        else:
            seen, at = np.unique(code, return_inverse=True)
        return letters[seen // (k * k)] << 42 | letters[seen // k % k] << 21 | letters[seen % k], at

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vector of each text, whether it has a letter, and its number of trigrams."""
        found = [self.symbols(t) for t in texts]
        lettered = np.array([bool((s != BLANK).any()) for s in found], bool)
        all_ = np.concatenate([x for s in found for x in (np.full(1, BLANK, np.int32), s, np.full(1, BLANK, np.int32))])
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(s) + 2 for s in found])
        keep = np.ones(len(all_), bool)  # a blank after a blank of the same text goes
        keep[1:] = (all_[1:] != BLANK) | (all_[:-1] != BLANK) | (owner[1:] != owner[:-1])
        all_, owner = all_[keep], owner[keep]
        inside = owner[2:] == owner[:-2]
        codes, at = self.coded(all_, inside)
        out = np.zeros((len(texts), self.d), np.float32)
        where = owner[2:][inside]
        for low in range(0, len(codes), PIECE):  # bounded room for texts of very many trigrams; all sums are whole numbers
            part = codes[low:low + PIECE]
            mine = (at >= low) & (at < low + len(part))
            counts = np.bincount(where[mine] * len(part) + (at[mine] - low), minlength=len(texts) * len(part)).reshape(len(texts), len(part))
            out += counts.astype(np.float32) @ self.rows(part)
        return out, lettered, np.bincount(where, minlength=len(texts))


def text_slices(texts: pa.Array, limit: int = SLICE_CHARS, most: int = 256) -> Iterator[tuple[int, list[str]]]:
    """Lists of at most ``most`` texts and about ``limit`` characters, with the place of each one's first; null is empty.
    Only so many texts at a time become Python strings."""
    for low in range(0, len(texts), most):
        begin, own, size = low, [], 0
        for i, text in enumerate(texts.slice(low, most).to_pylist(), low):
            text = text or ""
            if own and size + len(text) > limit:
                yield begin, own
                begin, own, size = i, [], 0
            own.append(text)
            size += len(text)
        yield begin, own


def remainder(doc_id: Column, folds: int = 5) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def learn(docs: DataFrame, train_docs: int = 20_000, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes. ``docs``: doc_id, text, lang. What comes to the driver is one vector per
    language."""
    small_batches(docs.sparkSession)
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("doc_id")) != 0)).select("doc_id", "text", "lang")
    known = known.withColumn("_d", F.xxhash64("doc_id", "text"))
    counts = known.select("lang", "_d").distinct().groupBy("lang").agg(F.count("*").alias("n"), F.min(F.pmod("_d", F.lit(1 << 30))).alias("first")).collect()
    places = max(LEAST_DOCS, train_docs // max(1, len(counts)))
    # the first of each language is always drawn, the others by their digest
    bounds = docs.sparkSession.createDataFrame([(r["lang"], max(r["first"] + 1, math.ceil(min(1.0, places / r["n"]) * (1 << 30)))) for r in counts], "lang string, bound long")
    drawn = known.join(F.broadcast(bounds), "lang").where(F.pmod("_d", F.lit(1 << 30)) < F.col("bound")).dropDuplicates(["lang", "_d"]).select("text", "lang")

    def bundle(batches):
        trigrams, sums = Trigrams(dimensions), {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for begin, own in text_slices(batch.column("text")):
                vectors, lettered, _ = trigrams.encode(own)
                for i, v in enumerate(vectors):
                    if lettered[i]:
                        lang = langs[begin + i]
                        sums[lang] = sums.get(lang, 0) + v / (len(own[i]) + 2.0)
        for lang, v in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang] * dimensions, "at": np.arange(dimensions, dtype=np.int32), "value": v.astype(np.float64)})

    sums = drawn.mapInArrow(bundle, "lang string, at int, value double").groupBy("lang", "at").agg(F.sum("value").alias("value"))
    rows = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("v")).orderBy("lang").collect()
    vectors = np.array([[x["value"] for x in r["v"]] for r in rows], np.float32).reshape(len(rows), dimensions)
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return [r["lang"] for r in rows], vectors / np.where(norms > 0, norms, 1) if len(rows) else np.zeros((0, dimensions), np.float32)


def predict(docs: DataFrame, languages: list[str], prototypes: np.ndarray) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (cosine, 0 at least) and the number of ``trigrams``; a column ``text`` is
    read, all others stay but those of the three names."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast((languages, np.asarray(prototypes, np.float32)))
    taken = [c for c in docs.columns if c not in ("lang_pred", "score", "trigrams")]
    schema = docs.select(*taken).schema.add("lang_pred", "string").add("score", "double").add("trigrams", "long")

    def judge(batches):
        names, table = model.value
        trigrams = Trigrams(table.shape[1] if len(names) else DIMENSIONS)
        for batch in batches:
            predicted, scores, sizes = [], [], []
            for _, own in text_slices(batch.column("text")):
                vectors, lettered, counts = trigrams.encode(own)
                sizes += counts.tolist()
                norms = np.linalg.norm(vectors, axis=1, keepdims=True)
                cosines = vectors @ table.T / np.where(norms > 0, norms, 1) if len(names) else np.zeros((len(own), 1))
                best = cosines.argmax(axis=1)
                for i in range(len(own)):
                    known = bool(lettered[i]) and len(names) > 0
                    predicted.append(names[best[i]] if known else NONE)
                    scores.append(min(1.0, max(0.0, float(cosines[i, best[i]]))) if known else 0.0)
            columns = [batch.column(c) for c in taken] + [pa.array(predicted, pa.string()), pa.array(scores, pa.float64()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*taken, "lang_pred", "score", "trigrams"])

    return docs.select(*taken).mapInArrow(judge, schema)
