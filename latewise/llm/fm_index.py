"""A word-level FM-index in numpy: suffix order, wavelet matrix, backward search, sampled positions."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with rank: packed words and the number of ones before each."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, dtype=bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        low = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class WaveletMatrix:
    """Rank and access over symbols, one bit vector a binary digit, highest digit first."""

    def __init__(self, symbols: np.ndarray, n_symbols: int) -> None:
        self.levels: list[tuple[int, Bits, int]] = []
        for digit in range(max(1, (n_symbols - 1).bit_length()) - 1, -1, -1):
            ones = (symbols >> digit & 1).astype(bool)
            self.levels.append((digit, Bits(ones), int(len(ones) - ones.sum())))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])
        every = np.arange(n_symbols)
        self.origin = self._descend(every, np.zeros(n_symbols, dtype=np.int64))

    def _descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for digit, bits, zeros in self.levels:
            ones = bits.rank(at)
            at = np.where(symbols >> digit & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its position."""
        return self._descend(symbols, at) - self.origin[symbols]

    def step(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and its rank there."""
        symbols = np.zeros(len(at), dtype=np.int64)
        for digit, bits, zeros in self.levels:
            one, ones = bits.get(at), bits.rank(at)
            symbols |= one.astype(np.int64) << digit
            at = np.where(one, zeros + ones, at - ones)
        return symbols, at - self.origin[symbols]


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Positions in suffix order by prefix doubling; each 0 is an end of its own, smaller the earlier it stands.

    Only suffixes that are not yet told apart are sorted again. Comparisons stop at an end, so the number of rounds is
    the logarithm of the longest stretch between two ends.
    """
    n, ends = len(text), text == 0
    rank = np.zeros(n + 1, dtype=np.int64)
    counts = np.bincount(text, minlength=2)
    rank[:n] = (np.cumsum(counts) - counts)[text]
    rank[:n][ends] = np.arange(ends.sum())
    open_at, reach = np.flatnonzero(~ends), 1
    while len(open_at):
        key = rank[open_at] * (n + 1) + rank[np.minimum(open_at + reach, n)]
        by_key = np.argsort(key)
        open_at, key = open_at[by_key], key[by_key]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        group = np.concatenate([[True], key[1:] // (n + 1) != key[:-1] // (n + 1)])
        # A suffix's new rank is its group's old rank plus its first place in the group.
        place = np.arange(len(key))
        first_of_group = np.maximum.accumulate(np.where(group, place, 0))
        first_equal = np.maximum.accumulate(np.where(new, place, 0))
        rank[open_at] = rank[open_at] + first_equal - first_of_group
        alone = new & np.concatenate([new[1:], [True]])
        open_at = open_at[~alone]
        reach *= 2
    order = np.empty(n, dtype=np.int64)
    order[rank[:n]] = np.arange(n)
    return order


class FMIndex:
    """Over symbols 1..n_symbols-1 with 0 as end mark; the text ends with one."""

    def __init__(self, text: np.ndarray, n_symbols: int, sample: int = 16) -> None:
        order = suffix_order(text)
        last = text[order - 1]
        counts = np.bincount(text, minlength=n_symbols)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.wavelet = WaveletMatrix(last, n_symbols)
        # A walk to the left never passes an end mark: what follows one is always sampled.
        sampled = (order % sample == 0) | (last == 0)
        self.sampled, self.positions = Bits(sampled), order[sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row range of each pattern (one pattern a line), by backward search."""
        low, high = self.first[patterns[:, -1]], self.first[patterns[:, -1] + 1]
        for column in range(patterns.shape[1] - 2, -1, -1):
            alive = np.flatnonzero(low < high)
            symbols = patterns[alive, column]
            low[alive] = self.first[symbols] + self.wavelet.rank(symbols, low[alive])
            high[alive] = self.first[symbols] + self.wavelet.rank(symbols, high[alive])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each row: steps to the left until a sampled one."""
        found = np.empty(len(rows), dtype=np.int64)
        at, which, steps = rows.copy(), np.arange(len(rows)), 0
        while len(at):
            known = self.sampled.get(at)
            found[which[known]] = self.positions[self.sampled.rank(at[known])] + steps
            at, which = at[~known], which[~known]
            if len(at):
                symbols, rank = self.wavelet.step(at)
                at = self.first[symbols] + rank
            steps += 1
        return found
