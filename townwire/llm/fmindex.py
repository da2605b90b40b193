"""A compressed FM-index over word ids: a wavelet matrix of the Burrows-Wheeler transform, as many bits a word as an id needs, searched for many patterns at once."""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """By prefix doubling. Symbol 0 separates texts; each separator is smaller than the ones behind it, so no comparison crosses one."""
    n = len(symbols)
    ends = np.flatnonzero(symbols == 0)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))
    step = 1
    while True:
        key = rank * (n + len(ends) + 1)
        key[:-step or None] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        ordered = key[order]
        new[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if new[order[-1]] == n - 1 or step >= n:
            return order
        rank, step = new, step * 2


class WaveletMatrix:
    """rank(symbol, i) over a sequence, in bit vectors of one level per bit of a symbol, with a running count for each 64 bits."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels = max(1, int(n_symbols - 1).bit_length())
        self.words, self.sums, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bits = (symbols >> level) & 1
            packed = np.packbits(np.pad(bits.astype(np.uint8), (0, 64 - len(bits) % 64)), bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.sums.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int32)]))
            self.zeros.append(int(len(bits) - bits.sum()))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])

    def descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where the first i places lead, following symbol; differences between two i count the symbol between them."""
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            at = i >> 6
            ones = self.sums[k][at] + np.bitwise_count(self.words[k][at] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))
            i = np.where((symbol >> level) & 1, self.zeros[k] + ones, i - ones)
        return i


class FMIndex:
    """Counts of patterns in texts of word ids >= 1."""

    def __init__(self, texts: list[np.ndarray], n_symbols: int):
        """n_symbols: one more than the largest id."""
        self.starts = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
        self.symbols = np.zeros(sum(len(t) + 1 for t in texts), np.int32)
        for at, t in zip(self.starts, texts):
            self.symbols[at : at + len(t)] = t
        self.n = len(self.symbols)
        bwt = self.symbols[suffix_array(self.symbols) - 1]
        self.tree = WaveletMatrix(bwt, n_symbols)
        below = np.concatenate([[0], np.cumsum(np.bincount(self.symbols, minlength=n_symbols))])[:n_symbols]
        every = np.arange(n_symbols)
        self.base = below - self.tree.descend(every, np.zeros(n_symbols, np.int64))

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The backward step: from the rows of patterns to those of the patterns with a symbol before them."""
        both = self.tree.descend(np.concatenate([symbol, symbol]), np.concatenate([low, high])) + np.concatenate([self.base[symbol]] * 2)
        return both[: len(symbol)], both[len(symbol) :]

    def repeated_windows(self, chosen: np.ndarray, n_windows: np.ndarray, width: int) -> list[tuple[int, int, int]]:
        """(text, first, last) runs of windows of width words that occur twice or more.

        Matching statistics by backward search: from a right end it goes left as long as what
        is read occurs twice. A range of windows is read from its last window's end first; if
        that stops within that very window, its first window is tried. What was read before the
        stop repeats, and windows that hold what was read and one more word don't, so either
        way a search settles many windows. All ranges of all texts advance together.
        """
        found: list[tuple[int, int, int]] = []
        text, lo, hi = chosen.copy(), np.zeros(len(chosen), np.int64), n_windows - 1
        single = np.zeros(len(chosen), bool)
        at = hi + width - 1
        low, high = np.zeros(len(chosen), np.int64), np.full(len(chosen), self.n)
        while len(text):
            symbol = self.symbols[self.starts[text] + at]
            low, high = self.extend(symbol, low, high)
            twice = high - low >= 2
            ended = ~twice | (at == lo)
            at = at - 1
            if not ended.any():
                continue
            more = []
            for t, a, b, stop, ok, one in zip(text[ended], lo[ended], hi[ended], at[ended] + 1, twice[ended], single[ended]):
                t, a, b, stop = int(t), int(a), int(b), int(stop)
                if ok:  # read down to the first window's start
                    found.append((t, a, a if one else b))
                    if one and a < b:
                        more.append((t, a + 1, b, False))
                elif one:  # no window from a to stop holds
                    if stop < b:
                        more.append((t, stop + 1, b, True))
                elif stop < b:  # windows behind the stop hold
                    found.append((t, stop + 1, b))
                    more.append((t, a, stop, False))
                elif a < b:  # the last window doesn't hold
                    more.append((t, a, b - 1, True))
            go = ~ended
            new = np.array(more, np.int64).reshape(-1, 4)
            text, lo, hi = (np.concatenate([x[go], new[:, k]]) for k, x in enumerate((text, lo, hi)))
            single = np.concatenate([single[go], new[:, 3].astype(bool)])
            fresh = np.where(new[:, 3], new[:, 1], new[:, 2]) + width - 1
            at = np.concatenate([at[go], fresh])
            low, high = np.concatenate([low[go], np.zeros(len(new), np.int64)]), np.concatenate([high[go], np.full(len(new), self.n)])
        return found
