"""Canonical texts of word sets and their windows, shared by problems 1 and 6.

The canonical text of a set is its 64-bit word hashes in ascending order. Of two sets of sizes a and b
with Jaccard similarity t or more, at least ``s = ceil(t / (1 + t) * (a + b))`` words are shared and at most
``d = a + b - 2 s`` are not. Each of those breaks the shared words into at most one run more, so in canonical
order the shared words lie in at most ``d + 1`` runs, and the sets have at least ``s - (q - 1) (d + 1)`` windows
of ``q`` consecutive words in common: the match threshold. ``width`` picks the largest q up to 3 whose
threshold is 1 or more for all sizes, so no similar pair is lost, whatever the data.

A record may leave out ``skip`` of its windows, one less than the least threshold it can meet, and
leaves out the most frequent ones. How frequent a window is, a histogram of RANGES ranges of window
keys tells; its size is fixed, and it decides the cost only, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOL_BITS, RANGE_BITS = 21, 18
RANGES = 1 << RANGE_BITS


def least_shared(a, b, similarity: float):
    """Least number of shared words of sets of sizes a and b (numbers or arrays)."""
    return np.ceil((a + b) * (similarity / (1 + similarity)) - 1e-9)


def threshold(a, b, similarity: float, q: int):
    """Least number of shared windows of q words."""
    s = least_shared(a, b, similarity)
    return s - (q - 1) * (a + b - 2 * s + 1)


def threshold_column(a: Column, b: Column, similarity: float, q: int) -> Column:
    s = F.ceil((a + b) * F.lit(similarity / (1 + similarity)) - F.lit(1e-9))
    return s - (q - 1) * (a + b - 2 * s + 1)


def least_threshold(sizes: np.ndarray, similarity: float, q: int, min_words: int) -> np.ndarray:
    """The least threshold that a set of each size can meet with any similar set."""
    known, inverse = np.unique(sizes, return_inverse=True)
    return np.array([_least_of(a, similarity, q, min_words) for a in known.tolist()], dtype=np.int64)[inverse]


@lru_cache(maxsize=65_536)
def _least_of(a: int, similarity: float, q: int, min_words: int) -> int:
    b = np.arange(max(min_words, int(np.ceil(similarity * a - 1e-9))), int(a / similarity + 1e-9) + 1)
    return int(threshold(a, b, similarity, q).min()) if len(b) else a


def width(similarity: float, min_words: int) -> int:
    """The largest window of 1 to 3 words that every two similar sets of at least ``min_words`` words share."""
    sizes = np.arange(min_words, 400)
    for q in (3, 2):
        slope = (2 * q - 1) * similarity / (1 + similarity) - (q - 1)
        if slope > 0.02 and least_threshold(sizes, similarity, q, min_words).min() >= 1:
            return q
    return 1


def window_keys(sig: pa.Array, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, sizes): the windows of an Arrow list of canonical texts.

    A key is the first bits of its words in turn, so keys sort as suffixes of the texts do by their first q words.
    """
    offsets = sig.offsets.to_numpy().astype(np.int64)
    words = sig.values.to_numpy()[offsets[0] : offsets[-1]] if len(sig) else np.zeros(0, np.int64)
    offsets = offsets - offsets[0]
    sizes = np.diff(offsets)
    symbols = (words & ((1 << SYMBOL_BITS) - 1)).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(words))
    at = at[at + q <= offsets[1:][row]] if len(at) else at
    key = np.zeros(len(at), np.int64)
    for k in range(q):
        key |= symbols[at + k] << (SYMBOL_BITS * (2 - k))
    return row[at], key, sizes


def ranges_of(key: np.ndarray) -> np.ndarray:
    return key >> (3 * SYMBOL_BITS - RANGE_BITS)


def parity_sketch(sig: pa.Array) -> np.ndarray:
    """Bit i tells whether an odd number of words fall in bin i of 64. A word in one of two sets only flips one bit,
    so the sketches of two sets differ in at most as many bits as the sets do in words."""
    offsets = sig.offsets.to_numpy().astype(np.int64)
    words = sig.values.to_numpy()[offsets[0] : offsets[-1]] if len(sig) else np.zeros(0, np.int64)
    bits = np.uint64(1) << ((words >> 40) & 63).astype(np.uint64)
    if not len(bits):
        return np.zeros(len(sig), np.int64)
    return np.bitwise_xor.reduceat(bits, offsets[:-1] - offsets[0]).view(np.int64)


def range_counts(sets: DataFrame, q: int, mask: bool = False) -> DataFrame:
    """(range, n): how many windows of (mask, sig) fall in each range of keys. At most RANGES rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(RANGES, np.int64)
        for b in batches:
            row, key, _ = window_keys(b.column(1), q)
            if mask:
                key = key ^ b.column(0).to_numpy()[row]
            seen += np.bincount(ranges_of(key), minlength=RANGES)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], ["range", "n"])

    rows = sets.select(F.col("mask") if mask else F.lit(0).cast("long").alias("mask"), "sig").mapInArrow(count, "range int, n long")
    return rows.groupBy("range").agg(F.sum("n").alias("n"))


def as_array(counts: DataFrame) -> np.ndarray:
    """The histogram as one array of RANGES numbers."""
    rows = counts.toPandas()
    out = np.zeros(RANGES, np.int64)
    out[rows["range"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.int64)
    return out


def hot_limit(counts: np.ndarray, longest: int, share: int = 16_384) -> int:
    """Windows in one range above which it is split: ``longest`` at least, and more than 1 / share of all, so that at most ``share`` ranges are."""
    return max(longest, int(counts.sum()) // share + 1)


def rarest(row: np.ndarray, key: np.ndarray, drop: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places of the windows of each row but its ``drop`` most frequent ones. The order (frequency, key) is the same for all rows."""
    order = np.lexsort((key, counts[ranges_of(key)], row))
    sorted_rows = row[order]
    n = np.bincount(row, minlength=len(drop))
    place = np.arange(len(row)) - (np.cumsum(n) - n)[sorted_rows]
    return order[place < (n - drop)[sorted_rows]]
