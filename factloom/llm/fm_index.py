"""An FM-index over integer symbols: suffix array, wavelet matrix, backward search, sampled positions.

All steps work on whole arrays of queries at once.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 16


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in order, by prefix doubling over the groups still tied.

    The text must end in a symbol that is less than all others and occurs nowhere else.
    """
    n = len(text)
    order = np.argsort(text, kind="stable")
    key = text[order]
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = key[1:] != key[:-1]
    # the rank of a suffix is the place of the first one of its group
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = first
    alone = new & np.append(new[1:], True)
    open_rows = np.flatnonzero(~alone)
    width = 1
    while len(open_rows):
        at = order[open_rows]
        key = first[open_rows] * np.int64(n + 1) + rank[np.minimum(at + width, n - 1)]
        by = np.argsort(key, kind="stable")
        order[open_rows] = at = at[by]
        key = key[by]
        new = np.empty(len(key), bool)
        new[0] = True
        new[1:] = key[1:] != key[:-1]
        start = np.maximum.accumulate(np.where(new, open_rows, 0))
        first[open_rows] = start
        rank[at] = start
        alone = new & np.append(new[1:], True)
        open_rows = open_rows[~alone]
        width *= 2
    return order


class WaveletMatrix:
    """Rank and access over a sequence of symbols in O(bits) bit-vector ranks."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.n = bits, len(symbols)
        self.words, self.before, self.zeros = [], [], []
        now = symbols.astype(np.uint32)
        for level in range(bits - 1, -1, -1):
            bit = ((now >> np.uint32(level)) & np.uint32(1)).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            packed = np.append(packed, np.zeros(-len(packed) % 8 + 8, np.uint8)).view(np.uint64)
            self.words.append(packed)
            self.before.append(np.append(0, np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]))
            self.zeros.append(int(self.n - bit.sum()))
            now = np.concatenate([now[~bit], now[bit]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        block = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[level][block] + np.bitwise_count(self.words[level][block] & mask)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place."""
        low = np.zeros(len(at), np.int64)
        for level in range(self.bits):
            one = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            ones_low, ones_at = self._ones(level, low), self._ones(level, at)
            low = np.where(one, self.zeros[level] + ones_low, low - ones_low)
            at = np.where(one, self.zeros[level] + ones_at, at - ones_at)
        return at - low

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and its occurrences before it."""
        symbol = np.zeros(len(at), np.int64)
        low = np.zeros(len(at), np.int64)
        for level in range(self.bits):
            one = ((self.words[level][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
            symbol = symbol * 2 + one
            ones_low, ones_at = self._ones(level, low), self._ones(level, at)
            low = np.where(one, self.zeros[level] + ones_low, low - ones_low)
            at = np.where(one, self.zeros[level] + ones_at, at - ones_at)
        return symbol, at - low


class FMIndex:
    """Counts and locates phrases in a text of symbols from 1 to ``alphabet`` - 1; 0 is kept for the end."""

    def __init__(self, text: np.ndarray, alphabet: int):
        text = np.append(text.astype(np.int64), 0)
        order = suffix_array(text)
        self.wavelet = WaveletMatrix(text[order - 1], max(1, int(alphabet - 1).bit_length()))
        self.starts = np.append(0, np.cumsum(np.bincount(text, minlength=alphabet)))
        sampled = order % SAMPLE == 0
        self.is_sampled, self.places = sampled, order[sampled]
        self.sampled_before = np.cumsum(sampled) - sampled

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [low, high) of the suffixes that begin with each row of ``phrases``, by backward search."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.wavelet.n, np.int64)
        live = np.arange(len(phrases))
        for column in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[live, column].astype(np.int64)
            low[live] = self.starts[symbol] + self.wavelet.rank(symbol, low[live])
            high[live] = self.starts[symbol] + self.wavelet.rank(symbol, high[live])
            live = live[high[live] > low[live]]
            if not len(live):
                break
        dead = high <= low
        low[dead] = high[dead] = 0
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: steps back through the text to the next sampled position."""
        at, steps, found = rows.copy(), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            done = self.is_sampled[at[live]]
            hit = live[done]
            found[hit] = self.places[self.sampled_before[at[hit]]] + steps[hit]
            live = live[~done]
            symbol, before = self.wavelet.access(at[live])
            at[live] = self.starts[symbol] + before
            steps[live] += 1
        return found
