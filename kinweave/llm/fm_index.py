"""A compressed FM-index over word ids, queried in bulk with numpy.

The Burrows-Wheeler transform of the indexed sequences is kept as a wavelet matrix of packed
bit vectors. Suffixes are ordered by their first DEPTH words only; that order answers every
pattern of up to DEPTH words exactly, since the suffixes that start with a pattern are
neighbours in it all the same.
"""

from __future__ import annotations

import numpy as np

DEPTH = 16  # a power of two


class BitVector:
    """Packed bits with a running count per word of 64."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        counts = np.bitwise_count(self.words).astype(np.uint32)
        self.before = np.concatenate([[0], np.cumsum(counts, dtype=np.uint32)[:-1]]).astype(np.uint32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    """Counts of any symbol before any position, in one bit vector per bit of the symbols."""

    def __init__(self, symbols: np.ndarray, limit: int):
        self.levels = max(1, int(limit - 1).bit_length())
        self.rows, self.zeros = [], []
        for level in reversed(range(self.levels)):
            bits = (symbols >> level) & 1
            self.rows.append(BitVector(bits))
            self.zeros.append(int(len(bits) - bits.sum()))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])
        every = np.arange(limit)
        self.base = self._descend(every, np.zeros(limit, np.int64))

    def _descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, (row, zeros) in enumerate(zip(self.rows, self.zeros, strict=True)):
            ones = row.rank(at).astype(np.int64)
            bit = (symbols >> (self.levels - 1 - k)) & 1
            at = np.where(bit == 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its position."""
        return self._descend(symbols, at) - self.base[symbols]


class FMIndex:
    """Index of integer sequences (symbols from 1); every sequence has a value.

    Patterns are found inside sequences only, never across two of them.
    """

    def __init__(self, sequences: list[np.ndarray], values: np.ndarray):
        lengths = np.array([len(s) + 1 for s in sequences], np.int64)
        text = np.zeros(int(lengths.sum()), np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        for at, s in zip(starts.tolist(), sequences, strict=True):
            text[at : at + len(s)] = s
        rank, width = text, 1
        while width < DEPTH:
            later = np.zeros(len(rank), np.int64)
            later[:-width] = rank[width:] + 1 if len(rank) > width else 0
            _, rank = np.unique(rank * (len(rank) + 2) + later, return_inverse=True)
            width *= 2
        order = np.argsort(rank, kind="stable")
        limit = int(text.max(initial=0)) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=limit))])
        self.limit, self.size = limit, len(text)
        self.bwt = WaveletMatrix(text[order - 1], limit)
        self.values = np.repeat(values, lengths)[order]

    def matches(self, text: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
        """Matching statistics up to ``width`` for the words of ``text`` before ``ends``.

        Extends each match to the left by backward search while it occurs more than once
        (once is the text itself, where it is indexed). Returns the matched length and the
        suffix interval [low, high) of the match, for each end.
        """
        low = np.zeros(len(ends), np.int64)
        high = np.full(len(ends), self.size, np.int64)
        length = np.zeros(len(ends), np.int64)
        alive = np.arange(len(ends))
        for step in range(1, width + 1):
            c = text[ends[alive] - step]
            both = self.bwt.rank(np.tile(c, 2), np.concatenate([low[alive], high[alive]]))
            fresh_low = self.first[c] + both[: len(c)]
            fresh_high = self.first[c] + both[len(c) :]
            kept = fresh_high - fresh_low > 1
            alive = alive[kept]
            low[alive], high[alive], length[alive] = fresh_low[kept], fresh_high[kept], step
            if len(alive) == 0:
                break
        return length, low, high

    def least_values(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The smallest value of the sequences in each suffix interval; each is looked at once."""
        if len(low) == 0:
            return np.empty(0, self.values.dtype)
        pairs, at = np.unique(low * (self.size + 1) + high, return_inverse=True)
        edges = np.stack(np.divmod(pairs, self.size + 1), axis=1).ravel()
        padded = np.append(self.values, self.values[-1:])
        return np.minimum.reduceat(padded, edges)[::2][at]
