"""A compressed FM-index over integer symbols: wavelet matrix with popcount ranks, vectorised searches."""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first ``depth`` symbols at least (prefix doubling), ties by position."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    width = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - width)] = rank[width:] + 1
        pair = rank * (n + 2) + after
        order = np.argsort(pair, kind="stable")
        steps = np.concatenate([[0], np.cumsum(pair[order][1:] != pair[order][:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = steps
        width *= 2
        if width >= depth or steps[-1] == n - 1:
            return order


class FMIndex:
    """Backward search over the Burrows-Wheeler transform of ``text`` (symbols from 0)."""

    def __init__(self, text: np.ndarray, depth: int):
        self.order = suffix_order(text, depth)
        bwt = text[self.order - 1]
        sigma = int(text.max()) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.levels = []
        begin, symbols = np.zeros(sigma, np.int64), np.arange(sigma)
        for shift in range(max(1, (sigma - 1).bit_length()) - 1, -1, -1):
            bit = ((bwt >> shift) & 1).astype(bool)
            padded = np.zeros(-(-(len(bit) + 1) // 64) * 64, np.uint8)
            padded[: len(bit)] = bit
            words = np.packbits(padded, bitorder="little").view("<u8")
            ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            level = (shift, words, ranks, int(len(bit) - bit.sum()))
            self.levels.append(level)
            begin = self._down(level, symbols, begin)
            bwt = np.concatenate([bwt[~bit], bwt[bit]])
        self.begin = begin

    @staticmethod
    def _down(level, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        shift, words, ranks, zeros = level
        block = at >> 6
        inside = words[block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        ones = ranks[block] + np.bitwise_count(inside)
        return np.where((symbol >> shift) & 1, zeros + ones, at - ones)

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of symbol + pattern from the intervals [lo, hi) of pattern."""
        both, at = np.concatenate([symbol, symbol]), np.concatenate([lo, hi])
        for level in self.levels:
            at = self._down(level, both, at)
        at = self.first[both] + at - self.begin[both]
        return at[: len(lo)], at[len(lo) :]


def repeated_windows(pieces: list[np.ndarray], weights: np.ndarray, asked: np.ndarray, window: int) -> list[int]:
    """For each piece in ``asked``, bits of its windows that occur with a total weight of 2 or more.

    Matching statistics by backward search, all windows of all asked pieces in step; a window
    leaves as soon as its interval holds a weight below 2.
    """
    sizes = np.array([len(p) for p in pieces])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    codes = np.unique(np.concatenate(pieces), return_inverse=True)[1] + 1
    text = np.zeros(int(sizes.sum() + len(pieces)), np.int64)
    owner = np.repeat(np.arange(len(pieces)), sizes + 1)
    symbol = np.ones(len(text), bool)
    symbol[starts + sizes] = False
    text[symbol] = codes
    index = FMIndex(text, int(sizes.max()) + 1)
    heavy = np.concatenate([[0], np.cumsum(weights[owner[index.order]])])
    counts = sizes[asked] - window + 1
    which = np.repeat(np.arange(len(asked)), counts)
    offset = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
    end = starts[asked][which] + offset + window - 1
    lo, hi = np.zeros(len(end), np.int64), np.full(len(end), len(text), np.int64)
    for step in range(window):
        lo, hi = index.extend(text[end - step], lo, hi)
        alive = heavy[hi] - heavy[lo] >= 2
        lo, hi, end, which, offset = lo[alive], hi[alive], end[alive], which[alive], offset[alive]
        if not len(end):
            break
    flags = np.zeros(len(asked), np.int64)
    np.bitwise_or.at(flags, which, np.int64(1) << offset)
    return flags.tolist()
