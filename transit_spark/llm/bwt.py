"""Suffix order, Burrows-Wheeler transform and wavelet matrix of a block of segments, in numpy."""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` symbols at least, by prefix tripling. Symbols are not negative.

    Each round sorts only the suffixes that equal another one so far, in the places that these have. A key is the rank of a
    suffix and those of the two after it by what is sorted so far; of blocks too large for three ranks in 63 bits, of one.
    """
    n = len(symbols)
    bits = (int(symbols.max()) + 1).bit_length() if n else 1
    step = max(1, min(62 // bits, depth))  # several symbols to one key, as many as fit
    padded = np.zeros(n + step, np.int64)
    padded[:n] = symbols
    padded[:n] += 1
    rank = padded[:n].copy()
    for k in range(1, step):
        rank <<= bits
        rank |= padded[k : k + n]
    order = np.argsort(rank)
    place = np.arange(n)  # places in the order whose suffixes aren't told apart yet
    ordered = rank[order]
    bits = max(1, n.bit_length())
    ranks = 2 if bits * 3 <= 63 else 1  # how many of them fit beside a suffix's own
    rank = np.zeros(n + ranks * depth + 1, np.int64)  # by position, from 1; what lies beyond the end comes before all
    while len(place):
        # a suffix ranks with the first place of those that equal it so far
        fresh = np.concatenate(([True], ordered[1:] != ordered[:-1]))
        those = order[place]
        rank[those] = np.maximum.accumulate(np.where(fresh, place, 0)) + 1
        if step >= depth:
            break
        on = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))
        place, those = place[on], those[on]
        key = rank[those]
        for k in range(1, ranks + 1):
            key <<= bits
            key |= rank[those + k * step]
        by = np.argsort(key)
        order[place], ordered = those[by], key[by]
        step *= ranks + 1
    return order


class WaveletMatrix:
    """Ranks of symbols in a sequence: one bit vector for each bit of the alphabet, with sampled counts."""

    def __init__(self, sequence: np.ndarray, alphabet: int) -> None:
        self.n = len(sequence)
        self.depth = max(1, int(alphabet - 1).bit_length())
        self.levels = []
        # where a symbol's places begin once all levels have dealt them by their bits, lowest bit first
        by = np.argsort(_reversed_bits(np.arange(alphabet), self.depth))
        counts = np.bincount(sequence, minlength=alphabet)[by]
        self.start = np.empty(alphabet, np.int64)
        self.start[by] = np.cumsum(counts) - counts
        sequence = sequence.astype(np.min_scalar_type(alphabet))
        for bit in range(self.depth - 1, -1, -1):
            ones = (sequence >> bit) & 1 == 1
            packed = np.zeros((self.n >> 6) + 1, np.uint64)
            raw = np.packbits(ones, bitorder="little")
            packed.view(np.uint8)[: len(raw)] = raw
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)))[:-1].astype(np.int32)
            self.levels.append((packed, before, self.n - int(ones.sum())))
            sequence = np.concatenate((sequence[~ones], sequence[ones]))

    @staticmethod
    def ones(level, at: np.ndarray) -> np.ndarray:
        packed, before, _ = level
        word = at >> 6
        return before[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        for d, level in enumerate(self.levels):
            up = (symbol >> (self.depth - 1 - d)) & 1 == 1
            ones = self.ones(level, at)
            at = np.where(up, level[2] + ones, at - ones)
        return at - self.start[symbol]

    def distinct(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The symbols in each range [low, high), with their ranks at both ends; ranges aren't told apart."""
        symbol = np.zeros(len(low), np.int64)
        for level in self.levels:
            a, b = self.ones(level, low), self.ones(level, high)
            up, down = b > a, (high - low) > (b - a)
            low = np.concatenate(((low - a)[down], (level[2] + a)[up]))
            high = np.concatenate(((high - b)[down], (level[2] + b)[up]))
            symbol = np.concatenate((symbol[down] << 1, (symbol[up] << 1) | 1))
        return symbol, low - self.start[symbol], high - self.start[symbol]


def _reversed_bits(values: np.ndarray, depth: int) -> np.ndarray:
    out = np.zeros(len(values), np.int64)
    for bit in range(depth):
        out = (out << 1) | ((values >> bit) & 1)
    return out


class Transform:
    """The transform of segments joined by separators that match nothing.

    Symbols 0 .. segments - 1 are separators in the suffix order, the others follow.
    """

    def __init__(self, symbols: np.ndarray, first: np.ndarray, alphabet: int, depth: int) -> None:
        self.segments = m = len(first) - 1
        joined = np.insert(symbols + m, first[1:], np.arange(m))
        self.n = len(joined)
        self.order = suffix_order(joined, depth)
        last = joined[self.order - 1]
        self.real = last >= m  # whether a segment's own symbol stands before the suffix
        # Separators are one symbol to the wavelet matrix, as no search goes through them.
        self.wavelet = WaveletMatrix(np.maximum(last - m + 1, 0), alphabet + 1)
        counts = np.bincount(np.maximum(joined - m + 1, 0), minlength=alphabet + 1)
        self.below = np.concatenate(([0], np.cumsum(counts)))[:-1]
        self.begin = first[:-1] + np.arange(m)
        self.segment = np.repeat(np.arange(m), np.diff(first) + 1)[self.order]
        self.joined = joined

    def before(self) -> np.ndarray:
        """The place in the order of the suffix one symbol longer, of each suffix; unless ``real``, of some other one."""
        place = np.empty(self.n, np.int64)
        place[self.order] = np.arange(self.n)
        return place[self.order - 1]
