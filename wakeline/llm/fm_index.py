"""A word-level FM-index: suffix order, wavelet-tree ranks, backward search, sampled locations."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling; the text ends in a symbol smaller than all others."""
    n = len(text)
    rank, step = text.astype(np.int64), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - step)] = rank[step:] + 1
        key = rank * (int(rank.max()) + 2) + after
        order = np.argsort(key)
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
        if new[order[-1]] == n - 1:
            return order
        rank, step = new, step * 2


class WaveletTree:
    """Ranks of symbols: one bit vector per level, stably parted by the bit (levelwise layout)."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.levels = []
        for bit in range(bits - 1, -1, -1):
            ones = (symbols >> bit) & 1
            self.levels.append((bit, np.concatenate(([0], np.cumsum(ones))).astype(np.int32), int(len(ones) - ones.sum())))
            symbols = np.concatenate((symbols[ones == 0], symbols[ones == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        start, end = np.zeros_like(at), at
        for bit, ones, zeros in self.levels:
            high = (symbol >> bit) & 1 == 1
            s, e = ones[start], ones[end]
            start, end = np.where(high, zeros + s, start - s), np.where(high, zeros + e, end - e)
        return end - start


class FMIndex:
    """Index of one shard. Symbol 0 ends the shard, 1 ends a passage, words are 2 and up."""

    def __init__(self, text: np.ndarray, sample: int = 16) -> None:
        order = suffix_array(text)
        self.n, self.bwt = len(text), text[order - 1]
        size = int(text.max()) + 1
        self.tree = WaveletTree(self.bwt, max(1, (size - 1).bit_length()))
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=size))))[:-1]
        self.sampled = order % sample == 0
        self.place = np.where(self.sampled, order, 0)

    def _back(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.first[symbol] + self.tree.rank(symbol, at)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of phrases of one length, all searched backwards at once."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[live, j]
            inside = symbol < len(self.first)
            live, symbol = live[inside], symbol[inside]
            both = self._back(np.concatenate((symbol, symbol)), np.concatenate((low[live], high[live])))
            low[live], high[live] = both[: len(live)], both[len(live) :]
            live = live[low[live] < high[live]]
            if not len(live):
                break
        found = np.zeros(len(phrases), bool)
        found[live] = True
        return np.where(found, low, 0), np.where(found, high, 0)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step back until a sampled one."""
        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            done = self.sampled[rows[todo]]
            out[todo[done]] = self.place[rows[todo[done]]] + steps[todo[done]]
            todo = todo[~done]
            symbol = self.bwt[rows[todo]]
            rows[todo] = self._back(symbol, rows[todo])
            steps[todo] += 1
        return out
