"""A word-level FM-index: Burrows-Wheeler text in a wavelet structure, searched backwards for many texts at once."""

from __future__ import annotations

import numpy as np


class BitVector:
    """Packed bits with rank: one running count per 64 bits."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[:len(bits)] = bits
        self.blocks = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.blocks), dtype=np.int64)])
        self.zeros = len(bits) - int(self.before[-1])

    def rank1(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        block = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.blocks[block] & mask)


class WaveletTree:
    """Symbols as one bit vector per level (highest bit first); all nodes of a level lie side by side."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels: list[tuple[int, BitVector]] = []
        for shift in range(max(1, int(n_symbols - 1).bit_length()) - 1, -1, -1):
            bits = ((symbols >> shift) & 1).astype(np.uint8)
            self.levels.append((shift, BitVector(bits)))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])
        self.first = self._walk(np.arange(n_symbols), np.zeros(n_symbols, np.int64))

    def _walk(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for shift, bits in self.levels:
            ones = bits.rank1(i)
            i = np.where((c >> shift) & 1, bits.zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol c occurs among the first i symbols."""
        return self._walk(c, i) - self.first[c]


class FmIndex:
    """Index of texts given as arrays of symbols >= 1, each with a number (its document).

    Suffixes are ordered by their first symbols up to a power of two that is not below ``depth``; that is all
    that backward search for patterns up to ``depth`` needs.
    """

    def __init__(self, texts: list[np.ndarray], owners: np.ndarray, depth: int):
        self.depth = depth
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes + 1)
        symbols = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
        for t, e in zip(texts, ends):
            symbols[e - 1 - len(t):e - 1] = t
        n = len(symbols)
        self.n_symbols = int(symbols.max(initial=0)) + 1
        rank, span = symbols, 1
        window = None  # classes of equal first ``depth`` symbols
        while span < depth:
            if 2 * span >= depth:
                window = self._refine(rank, depth - span)
            rank, span = self._refine(rank, span), 2 * span
        if window is None:
            window = rank
        order = np.argsort(rank, kind="stable")
        self.tree = WaveletTree(symbols[order - 1], self.n_symbols)
        counts = np.bincount(symbols, minlength=self.n_symbols)
        self.smaller = np.concatenate([[0], np.cumsum(counts)[:-1]])
        # Rows whose first ``depth`` symbols agree: shortening a match to ``depth`` gives this range of rows.
        kind = window[order]
        starts = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
        self.run = np.cumsum(np.concatenate([[0], (kind[1:] != kind[:-1]).astype(np.int64)]))
        self.run_start, self.run_end = starts, np.concatenate([starts[1:], [n]])
        owner = np.repeat(owners, sizes + 1)[order]
        self.run_owner = np.minimum.reduceat(owner, starts)
        self.size = n

    @staticmethod
    def _refine(rank: np.ndarray, step: int) -> np.ndarray:
        """Ranks by (rank, rank ``step`` further on)."""
        later = np.zeros(len(rank), np.int64)
        later[:-step or None] = rank[step:] + 1
        key = rank * (int(later.max(initial=0)) + 1) + later
        order = np.argsort(key, kind="stable")
        new = np.empty(len(rank), np.int64)
        new[order] = np.cumsum(np.concatenate([[0], (np.diff(key[order]) != 0).astype(np.int64)]))
        return new

    def first_owner(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """For each window of ``depth`` symbols of each text: the smallest owner of an indexed text with it.

        The texts must be indexed themselves. All are searched in step, last symbol first: a step extends the
        matches by one symbol to the left; a match longer than ``depth`` is shortened to it at the right.
        """
        sizes = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-sizes, kind="stable")
        flat = np.concatenate([texts[k] for k in order]) if len(order) else np.zeros(0, np.int64)
        end = np.cumsum(sizes[order])
        long = sizes[order]
        low, high = np.zeros(len(order), np.int64), np.full(len(order), self.size, np.int64)
        found = [np.zeros(max(0, s - self.depth + 1), np.int64) for s in sizes]
        hits: list[np.ndarray] = []
        for step in range(int(long[0]) if len(long) else 0):
            active = int(np.searchsorted(-long, -step, "left"))  # texts with a symbol left
            c = flat[end[:active] - 1 - step]
            low, high = (self.smaller[c] + self.tree.rank(c, x[:active]) for x in (low, high))
            if step >= self.depth - 1:
                run = self.run[low]
                low, high = self.run_start[run], self.run_end[run]
                hits.append(self.run_owner[run])
        for back, owners in enumerate(hits):  # windows from the last to the first
            for k, o in zip(order[:len(owners)].tolist(), owners.tolist()):
                found[k][-1 - back] = o
        return found
