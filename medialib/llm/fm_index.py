"""A compressed full-text index of word sequences: backward search over a wavelet matrix, for many sequences at once."""

from __future__ import annotations

import numpy as np

from .common import ranges


class Bits:
    """A bit vector with constant-time rank: 64-bit words and the ones before each."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.cumsum(ones, dtype=np.int32) - ones

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones among the first `at` bits."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below).astype(np.int64)


class WaveletMatrix:
    """Counts of a symbol in a prefix of a sequence, in as many steps as a symbol has bits."""

    def __init__(self, seq: np.ndarray, symbols: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for bit in range(max(1, int(symbols - 1).bit_length()) - 1, -1, -1):
            ones = (seq >> bit & 1).astype(bool)
            self.levels.append((bit, Bits(ones), int(len(seq) - ones.sum())))
            seq = np.concatenate([seq[~ones], seq[ones]])
        self.start = self._down(np.arange(symbols), np.zeros(symbols, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, bits, zeros in self.levels:
            ones = bits.rank(at)
            at = np.where(symbol >> bit & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._down(symbol, at) - self.start[symbol]


class FMIndex:
    """Word sequences, parted by symbol 0, whose suffixes are sorted by as many words as a window has.

    order[k] has the suffixes' ranks by their first 2**k words, from rounds of doubling.
    """

    def __init__(self, text: np.ndarray, symbols: int, window: int):
        self.window, self.ranks = window, [text.astype(np.int64)]
        while 1 << (len(self.ranks) - 1) < window:
            order, step = self.ranks[-1], 1 << (len(self.ranks) - 1)
            nxt = np.zeros_like(order)
            nxt[:-step] = order[step:] + 1
            _, order = np.unique(order * (order.max(initial=0) + 2) + nxt, return_inverse=True)
            self.ranks.append(order)
        self.suffixes = np.argsort(self.ranks[-1], kind="stable")
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.bwt = WaveletMatrix(text[self.suffixes - 1].astype(np.int64), symbols)

    def groups(self, depth: int) -> np.ndarray:
        """The rows at which suffixes with other first `depth` words begin, and the number of rows."""
        if depth < 1:
            return np.array([0, len(self.suffixes)])
        k = depth.bit_length() - 1
        fresh = np.zeros(len(self.suffixes), bool)
        fresh[:1] = True
        for at in (0, depth - (1 << k)):
            own = np.append(self.ranks[k], np.full(depth, -1))[self.suffixes + at]
            fresh[1:] |= own[1:] != own[:-1]
        return np.append(np.flatnonzero(fresh), len(fresh))

    def matched(self, text: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the sequences' windows start, and a row of the suffixes that start with each.

        All sequences are read from their last word to their first, side by
        side. Each keeps the rows of the suffixes that start with what it matched
        last: a word more narrows them by backward search; a match as long as a
        window first gives up its last word, which widens the rows to those
        with the same words before it. These are matching statistics, cut off at
        the threshold that is asked for.
        """
        widen = self.groups(self.window - 1)
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), len(text), np.int64)
        starts, rows = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        by_size = np.argsort(-sizes, kind="stable")
        for step in range(1, int(sizes.max(initial=0)) + 1):
            own = by_size[: int(np.searchsorted(-sizes[by_size], -step, side="right"))]
            at = ends[own] - step
            begin, end = low[own], high[own]
            if step > self.window:
                group = np.searchsorted(widen, begin, side="right") - 1
                begin, end = widen[group], widen[group + 1]
            symbol = text[at]
            both = self.bwt.rank(np.concatenate([symbol, symbol]), np.concatenate([begin, end]))
            low[own] = self.first[symbol] + both[: len(own)]
            high[own] = self.first[symbol] + both[len(own) :]
            if step >= self.window:
                there = own[low[own] < high[own]]
                starts.append(ends[there] - step)
                rows.append(low[there])
        return np.concatenate(starts), np.concatenate(rows)


def windows_shared(
    words: np.ndarray, sizes: np.ndarray, places: np.ndarray, lowest: np.ndarray, highest: np.ndarray, window: int
) -> tuple[np.ndarray, np.ndarray]:
    """For each window of each word sequence (words: one after the other): the lowest and highest document among the sequences that have it."""
    names, symbol = np.unique(words, return_inverse=True)
    ends = np.cumsum(sizes + 1)
    text = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
    text[ranges(ends - sizes, sizes)] = symbol + 1
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    index = FMIndex(text, len(names) + 1, window)
    groups = index.groups(window)
    by_row = owner[index.suffixes]
    least, most = np.minimum.reduceat(lowest[by_row], groups[:-1]), np.maximum.reduceat(highest[by_row], groups[:-1])
    starts, rows = index.matched(text, ends, sizes)
    group = np.searchsorted(groups, rows, side="right") - 1
    counts = np.maximum(0, sizes - window + 1)
    number = np.cumsum(counts) - counts  # of a sequence's first window
    low, high = np.repeat(lowest, counts), np.repeat(lowest, counts)  # not found: shared with none
    own = owner[starts]
    at = number[own] + starts - (ends - sizes)[own]
    low[at], high[at] = least[group], most[group]
    return low, high
