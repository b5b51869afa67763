"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader (FTRL-Proximal).

Features are hashed into ``1 << BITS`` places: words, pairs of neighbouring words, the runs of signs between words
and pairs of neighbouring runs. A pair's hash comes from the difference of its parts, so a word that follows
itself is one feature whatever the word. Values are 1 + log of the count, scaled to length 1.

The model is fitted on at most ``train_docs`` labelled documents, first by a digest of their id (a documented
bound), in one task; rows of one id and text are one document there, and the bound holds for what is joined; every document is then scored in place as a sparse dot product. Defined results: null and
empty texts get the score of the bias alone; null labels and null ids are not learnt from, and a null id is not held
out; a document with several labels is learnt once per label; without any label the score is 0.5; an empty table
gives no rows; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import content_key
from .language_id import remainder
from .wordhash import WordHasher, mix, slices

BITS = 18
ALPHA, BETA, L1, L2, EPOCHS = 3.0, 1.0, 0.01, 0.001, 5


def sign_bytes() -> np.ndarray:
    """Table for the runs between words: every byte that belongs to no word, line ends and tabs as blanks."""
    table = np.zeros(256, np.uint8)
    for i in range(1, 0x80):
        if not chr(i).isalnum():
            table[i] = 32 if chr(i).isspace() else i
    return table


class Features:
    def __init__(self):
        self.words, self.signs = WordHasher(), WordHasher(sign_bytes())

    def of(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Places and values of each text."""
        parts = []
        for salt, hasher in ((1, self.words), (2, self.signs)):
            hashes, places = hasher.words(texts)
            pairs = mix(hashes[:-1] - hashes[1:] + np.uint64(salt)) if len(hashes) else hashes
            parts.append((hashes + np.uint64(salt), pairs, places))
        out = []
        for i in range(len(texts)):
            own = [x for hashes, pairs, p in parts for x in (hashes[p[i]:p[i + 1]], pairs[p[i]:max(p[i], p[i + 1] - 1)])]
            at, n = np.unique(np.concatenate(own) >> np.uint64(64 - BITS), return_counts=True)
            value = 1 + np.log(n)
            out.append((at.astype(np.int32), (value / max(1e-9, np.sqrt((value ** 2).sum()))).astype(np.float32)))
        return out


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit(examples: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """Weights, with the bias in the last place."""
    size = (1 << BITS) + 1
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    for _ in range(EPOCHS):
        for at, value, label in examples:
            at, value = np.append(at, size - 1), np.append(value, 1.0)
            zi, ni = z[at], n[at]
            wi = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            g = (sigmoid((wi * value).sum()) - label) * value
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * wi
            n[at] = ni + g * g
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)).astype(np.float32)


def learn(docs: DataFrame, labels: DataFrame, train_docs: int = 8_000) -> np.ndarray:
    """Weights from ``docs`` (doc_id, text) and ``labels`` (doc_id, quality)."""
    drawn = (labels.where(F.col("quality").isNotNull() & (remainder(F.col("doc_id")) != 0))
             .select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("label"))
             .orderBy(F.xxhash64("_id", F.lit(7)), "_id", "label").limit(train_docs))
    text = docs.select(F.col("doc_id").alias("_id"), "text").join(F.broadcast(drawn.select("_id")), "_id", "left_semi")
    text = text.withColumn("_t", content_key(F.col("text"))).dropDuplicates(["_id", "_t"])
    rows = text.join(F.broadcast(drawn), "_id").select("_id", "label", "text")  # at most train_docs pairs of numbers

    def encode(batches):
        features = Features()
        for batch in batches:
            ids, labels_ = batch.column("_id").to_pylist(), batch.column("label").to_pylist()
            for begin, own in slices(batch.column("text").to_pylist()):
                found = features.of(own)
                yield pa.RecordBatch.from_pydict({"id": pa.array(ids[begin:begin + len(own)], pa.int64()), "label": pa.array(labels_[begin:begin + len(own)], pa.int32()),
                                                  "at": pa.array([a.tobytes() for a, _ in found], pa.binary()), "value": pa.array([v.tobytes() for _, v in found], pa.binary())})

    def train(batches):
        examples = [(np.frombuffer(a, np.int32), np.frombuffer(v, np.float32), y) for b in batches
                    for a, v, y in zip(b.column("at").to_pylist(), b.column("value").to_pylist(), b.column("label").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_pydict({"weights": pa.array([fit(examples).tobytes()], pa.binary())})

    encoded = rows.mapInArrow(encode, "id long, label int, at binary, value binary")
    order = (F.xxhash64("id", F.lit(11)), "id", "label", "at")
    # an id with many texts has more rows than labels; the bound comes before they meet in one task
    bounded = encoded.orderBy(F.xxhash64("id", "at", "value"), "id", "label", "at").limit(train_docs)
    got = bounded.repartition(1).sortWithinPartitions(*order).mapInArrow(train, "weights binary").collect()
    return np.frombuffer(got[0]["weights"], np.float32) if got else np.zeros((1 << BITS) + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``doc_id`` and ``score`` of every row."""
    model = docs.sparkSession.sparkContext.broadcast(weights)

    def judge(batches):
        features, w = Features(), model.value
        for batch in batches:
            out = [float(sigmoid(float((w[at] * value).sum()) + float(w[-1]))) for _, own in slices(batch.column("text").to_pylist()) for at, value in features.of(own)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.float64())], names=["doc_id", "score"])

    schema = docs.select("doc_id").schema.add("score", "double")
    return docs.select("doc_id", "text").mapInArrow(judge, schema)
