"""Words and word shingles of whole texts as 64-bit hashes, in numpy over slices of an Arrow batch.

A word is a run of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are lower-cased. Over UTF-8 bytes those are the
digits, a-z and every byte of 0x80 and more, so a table of 256 bytes finds them. A word's hash is a polynomial of
its bytes modulo 2**64, taken from running sums, and then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MASK = (1 << 64) - 1
SLICE_BYTES = 1 << 20
_BASE, _STEP = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_bytes() -> np.ndarray:
    """Byte to itself, lower-cased, if it belongs to a word; else 0."""
    table = np.zeros(256, np.uint8)
    table[0x80:] = np.arange(0x80, 0x100)
    table[ord("0"):ord("9") + 1] = np.arange(ord("0"), ord("9") + 1)
    table[ord("a"):ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
    table[ord("A"):ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
    return table


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class WordHasher:
    """Keeps the tables between slices."""

    def __init__(self, table: np.ndarray | None = None):
        self.table = word_bytes() if table is None else table
        self.up = self.down = np.ones(0, np.uint64)

    def edges(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words begin and end."""
        is_word = data != 0
        edge = np.flatnonzero(is_word[1:] != is_word[:-1]) + 1
        return edge[0::2], edge[1::2]

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every word, and for each text the place of its first word (one more entry at the end)."""
        joined = np.frombuffer(b"\x00" + b"\x00".join(texts) + b"\x00", np.uint8)
        data = self.table[joined]
        if len(self.up) < len(data):
            self.up, self.down = powers(_BASE, len(data)), powers(pow(_BASE, -1, 1 << 64), len(data))
        start, end = self.edges(data)
        total = np.cumsum(data * self.up[:len(data)], dtype=np.uint64)
        hashes = mix((total[end - 1] - total[start - 1]) * self.down[start] + (end - start).astype(np.uint64))
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        places = np.searchsorted(start, np.concatenate([[0], np.cumsum(lengths)]) + 1)
        return hashes, places


def shingles(words: np.ndarray, places: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``width`` words inside a text; a text of fewer words, but not none, has one shingle of
    all its words. Returns the hashes and each text's first place, as above."""
    counts = np.diff(places)
    if len(words) == 0:
        return words, np.zeros(len(places), np.int64)
    rolled = np.zeros(len(words), np.uint64)
    for k in range(width):
        rolled[:len(words) - k] += words[k:] * np.uint64(pow(_STEP, k + 1, 1 << 64))
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    first = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(first[-1]) - np.repeat(first[:-1], n) + np.repeat(places[:-1], n)
    out = rolled[at]
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        own = words[places[i]:places[i + 1]]
        out[first[i]] = np.uint64(sum(int(w) * pow(_STEP, k + 1, 1 << 64) for k, w in enumerate(own)) + len(own) & MASK)
    return mix(out), first


def slices(texts: list[str | None] | pa.Array, limit: int = SLICE_BYTES, most: int = 256) -> Iterator[tuple[int, list[bytes]]]:
    """The texts as UTF-8 in slices of about ``limit`` bytes, with the place of each slice's first text; null is
    empty. A longer text is a slice of its own. Of an Arrow column, ``most`` texts at a time become Python bytes."""
    if isinstance(texts, pa.Array):
        raws = (raw or b"" for low in range(0, len(texts), most) for raw in texts.slice(low, most).cast(pa.binary()).to_pylist())
    else:
        raws = (b"" if text is None else text.encode("utf-8", "surrogatepass") for text in texts)
    begin, own, size = 0, [], 0
    for i, raw in enumerate(raws):
        if own and size + len(raw) > limit:
            yield begin, own
            begin, own, size = i, [], 0
        own.append(raw)
        size += len(raw)
    if own:
        yield begin, own
