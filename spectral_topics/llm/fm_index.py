"""An FM-index over a sequence of symbols, for many patterns at once: all steps work on arrays."""

from __future__ import annotations

import numpy as np

#: Every SAMPLE-th position of the sequence is stored with its row.
SAMPLE = 8


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of all suffixes. The last symbol must be smaller than all others.

    Prefix doubling: suffixes sorted by their first k symbols are sorted by 2k through the ranks of
    the suffixes k further on. Only suffixes that still share a rank are sorted again.
    """
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s), np.int64)
    new = np.ones(len(s), bool)
    new[1:] = s[order[1:]] != s[order[:-1]]
    places = np.arange(len(s))
    k = 1
    while True:
        # The rank of a group of equal suffixes is the place of its first one.
        heads = np.maximum.accumulate(np.where(new, places, 0))
        rank[order] = heads
        alone = new.copy()
        alone[:-1] &= new[1:]
        open_places = places[~alone]
        if not len(open_places):
            return order
        held = order[open_places]
        first, then = rank[held], rank[held + k]
        sorting = np.lexsort((then, first))
        order[open_places] = held[sorting]
        first, then = first[sorting], then[sorting]
        new[open_places[1:]] |= (first[1:] != first[:-1]) | (then[1:] != then[:-1])
        k *= 2


class Bits:
    """Bits with counts of ones before any place."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def ones(self, i: np.ndarray) -> np.ndarray:
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        below = (np.uint64(1) << bit) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below).astype(np.int64)

    def at(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1


class WaveletTree:
    """Ranks of symbols in a sequence. Level by level, highest bit first; zeros go before ones."""

    def __init__(self, s: np.ndarray, largest: int) -> None:
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in reversed(range(max(1, int(largest).bit_length()))):
            bits = (s >> shift) & 1 == 1
            self.levels.append((shift, Bits(bits), int((~bits).sum())))
            s = np.concatenate((s[~bits], s[bits]))

    def rank(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        start = np.zeros_like(i)
        for shift, bits, zeros in self.levels:
            one = (symbols >> shift) & 1 == 1
            a, b = bits.ones(start), bits.ones(i)
            start = np.where(one, zeros + a, start - a)
            i = np.where(one, zeros + b, i - b)
        return i - start

    def symbol_and_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and how often it occurs before."""
        symbol, start = np.zeros_like(i), np.zeros_like(i)
        for shift, bits, zeros in self.levels:
            one = bits.at(i)
            a, b = bits.ones(start), bits.ones(i)
            start = np.where(one, zeros + a, start - a)
            i = np.where(one, zeros + b, i - b)
            symbol += one.astype(np.int64) << shift
        return symbol, i - start


class FMIndex:
    """Finds all places of patterns in a sequence of positive symbols; 0 may separate parts."""

    def __init__(self, s: np.ndarray, largest: int) -> None:
        # Symbols move up by one: the end of the sequence is smaller than all of them.
        s = np.concatenate((s.astype(np.int64) + 1, [0]))
        order = suffix_array(s)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(s, minlength=largest + 2))))
        self.tree = WaveletTree(s[order - 1], largest + 1)
        sampled = order % SAMPLE == 0
        self.sampled = Bits(sampled)
        self.places = order[sampled]
        self.size = len(s)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and end of the rows of each pattern (rows of an array of symbols): backward search."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.size, np.int64)
        alive = np.arange(len(patterns))
        for column in reversed(range(patterns.shape[1])):
            c = patterns[alive, column].astype(np.int64) + 1
            low[alive] = self.first[c] + self.tree.rank(c, low[alive])
            high[alive] = self.first[c] + self.tree.rank(c, high[alive])
            alive = alive[low[alive] < high[alive]]
            if not len(alive):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Place in the sequence of the suffix at each row: steps back to the nearest sampled one."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        out = np.empty(len(rows), np.int64)
        open_rows = np.arange(len(rows))
        while len(open_rows):
            at = rows[open_rows]
            known = self.sampled.at(at)
            done = open_rows[known]
            out[done] = self.places[self.sampled.ones(rows[done])] + steps[done]
            open_rows = open_rows[~known]
            symbol, rank = self.tree.symbol_and_rank(rows[open_rows])
            rows[open_rows] = self.first[symbol] + rank
            steps[open_rows] += 1
        return out
