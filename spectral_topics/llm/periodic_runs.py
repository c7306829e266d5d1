"""Runs of periodically repeated words, found by block convolution.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), at least
``exponent`` times as long as q and at least ``shortest`` words long, that no neighbouring word extends.

At each dyadic scale L a document's words are cut into blocks of L. A run whose period is between L and 2L - 1
holds a whole block and the block's copy one period later, because it is at least three periods long. So every
block is compared with all its shifts by L to 2L - 1 words at once: the sum of squared differences of the words' numbers is
block squares + window squares - 2 correlation, and the correlation is a product of number-theoretic
transforms. The sums are taken modulo as many primes as make their product larger than any possible sum, so a sum is
zero modulo all of them only where nothing differs. Each such distance is a seed: it is extended to both sides word by
word, and kept if the stretch is long enough and no divisor of the distance is its period as well. Seeds inside
a run found at a smaller scale, at a multiple of its period, are that run again and are passed over.

One pass without a shuffle: a document is one row. Documents are taken in slices of bounded bytes, and blocks of all
documents of a slice are transformed together in arrays of bounded size (a longer document's own size at most).
Work grows as n log^2 n with a document's words, whatever it repeats.

Defined results
- Words are maximal stretches without white space (space, U+0009 to U+000D), compared byte by byte. A null text has none.
- ``runs`` is sorted by start, then period; it is empty where there is no run, never null.
- ``collapsed`` joins the words that stay by one space. A word goes if some run holds it behind its first q words.
- Repeated ids give repeated rows. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spectral_topics.llm.common import arrow_map, forget, id_and_text, slices, text_bytes

# Primes k 2^m + 1 below 2^31 and a primitive root of each.
PRIMES = ((2013265921, 31), (1811939329, 13), (469762049, 3))
#: Numbers in one array of transforms, unless a single block needs more.
CELLS = 1 << 16
#: Bytes of text whose words are handled together.
SLICE_BYTES = 1 << 20
SCHEMA = "id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


class Transform:
    """Number-theoretic transforms of ``size`` numbers (a power of two) modulo a prime, along the first axis.

    ``forward`` leaves its result in bit-reversed order, which ``inverse`` takes.
    """

    def __init__(self, size: int, prime: int, root: int) -> None:
        self.size, self.prime = size, np.uint64(prime)
        unit = pow(root, (prime - 1) // size, prime)
        self.down = self.powers(unit, size // 2)
        self.up = self.powers(pow(unit, -1, prime), size // 2)
        self.scale = np.uint64(pow(size, -1, prime))

    def powers(self, base: int, n: int) -> np.ndarray:
        out = np.ones(1, np.uint64)
        while len(out) < n:
            out = np.concatenate([out, self.times(out, np.uint64(pow(base, len(out), int(self.prime))))])
        return out

    def times(self, a, b) -> np.ndarray:
        product = a * b
        product -= product // self.prime * self.prime
        return product

    def plus(self, a, b) -> np.ndarray:
        total = a + b
        return np.minimum(total, total - self.prime)

    def minus(self, a, b) -> np.ndarray:
        difference = a - b
        return np.minimum(difference, difference + self.prime)

    def forward(self, values: np.ndarray) -> np.ndarray:
        half = self.size // 2
        while half:
            pair = values.reshape(-1, 2, half, values.shape[1])
            weights = self.down[:: self.size // 2 // half].reshape(-1, 1)
            out = np.empty_like(pair)
            out[:, 0] = self.plus(pair[:, 0], pair[:, 1])
            out[:, 1] = self.times(self.minus(pair[:, 0], pair[:, 1]), weights)
            values = out.reshape(values.shape)
            half //= 2
        return values

    def inverse(self, values: np.ndarray) -> np.ndarray:
        half = 1
        while half < self.size:
            pair = values.reshape(-1, 2, half, values.shape[1])
            other = self.times(pair[:, 1], self.up[:: self.size // 2 // half].reshape(-1, 1))
            out = np.empty_like(pair)
            out[:, 0] = self.plus(pair[:, 0], other)
            out[:, 1] = self.minus(pair[:, 0], other)
            values = out.reshape(values.shape)
            half *= 2
        return self.times(values, self.scale)


def zero_distances(blocks: np.ndarray, windows: np.ndarray, transform: Transform) -> np.ndarray:
    """Whether the squared differences of each block (a column) and its window from row j on sum to zero modulo the prime.

    There are L rows of blocks and 2L - 1 of windows; the result has L rows.
    """
    length, t = len(blocks), transform
    mirrored = np.zeros((t.size, blocks.shape[1]), np.uint64)
    mirrored[0], mirrored[t.size - length + 1 :] = blocks[0], blocks[:0:-1]
    padded = np.zeros_like(mirrored)
    padded[: len(windows)] = windows
    correlation = t.inverse(t.times(t.forward(mirrored), t.forward(padded)))[:length]
    own = t.times(blocks, blocks).sum(axis=0) % t.prime
    sums = np.zeros_like(mirrored)
    np.cumsum(t.times(windows, windows), axis=0, out=sums[1:])
    theirs = (sums[length:] - sums[:length]) % t.prime
    return t.plus(own, theirs) == t.plus(correlation, correlation)


class RunFinder:
    def __init__(self, exponent: int = 4, shortest: int = 6) -> None:
        if exponent < 3:
            raise ValueError("a run must be at least three periods long, so that it holds a block and its copy")
        self.exponent, self.shortest = exponent, shortest
        self.transforms: dict[tuple[int, int], Transform] = {}

    def transform(self, size: int, k: int) -> Transform:
        if (size, k) not in self.transforms:
            self.transforms[size, k] = Transform(size, *PRIMES[k])
        return self.transforms[size, k]

    def seeds(self, x: np.ndarray, begins: np.ndarray, sizes: np.ndarray, symbols: np.ndarray, length: int):
        """``(document, place, distance)`` of all blocks of ``length`` that occur again ``length`` to 2 length - 1 words on."""
        long = np.flatnonzero(sizes >= max(self.exponent * length, self.shortest))
        counts = sizes[long] // length - 1
        owner = np.repeat(long, counts)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        starts = begins[owner] + at * length
        ends = begins[owner] + sizes[owner]
        step = max(1, CELLS // (2 * length))
        for i in range(0, len(owner), step):
            who, start, end = owner[i : i + step], starts[i : i + step], ends[i : i + step]
            blocks = x[start + np.arange(length)[:, None]]
            place = start + length + np.arange(2 * length - 1)[:, None]
            # Behind the document's end stands a number that none of its words has.
            windows = np.where(place < end, x[np.minimum(place, len(x) - 1)], symbols[who].astype(np.uint64))
            largest = length * int(symbols[who].max()) ** 2
            zero, k, product = None, 0, 1
            while product <= largest:
                t = self.transform(2 * length, k)
                now = zero_distances(blocks, windows, t)
                zero = now if zero is None else zero & now
                product *= PRIMES[k][0]
                k += 1
                if not zero.any():
                    break
            distance, block = np.nonzero(zero)
            yield who[block], start[block], distance + length

    def find(self, x: np.ndarray, begins: np.ndarray, sizes: np.ndarray, symbols: np.ndarray) -> list[tuple[int, int, int, int]]:
        """``(document, start, length, period)`` of all runs of documents that lie one behind the other in ``x``.

        ``x`` holds the words' numbers, from 0 to a document's ``symbols`` - 1.
        """
        found = []
        period_at, end_at = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        length = 1
        while len(sizes) and self.exponent * length <= sizes.max():
            for doc, start, distance in self.heads(x, begins, sizes, symbols, length):
                inside = period_at[start]
                known = (inside > 0) & (distance % np.maximum(inside, 1) == 0) & (end_at[start] >= start + length + distance)
                for d, g, q in zip(doc[~known].tolist(), start[~known].tolist(), distance[~known].tolist()):
                    low, high = int(begins[d]), int(begins[d] + sizes[d])
                    first = g - same_words(x[low:g][::-1], x[low + q : g + q][::-1])
                    last = g + length + q + same_words(x[g + length : high - q], x[g + length + q : high])
                    if last - first >= max(self.shortest, self.exponent * q) and is_smallest(x[first:last], q):
                        found.append((d, first - low, last - first, q))
                        period_at[first:last], end_at[first:last] = q, last
            length *= 2
        return sorted(found, key=lambda r: (r[0], r[1], r[3]))

    def heads(self, x, begins, sizes, symbols, length):
        """The first seed of each chain of neighbouring blocks with the same distance, one array for each kind."""
        parts = list(self.seeds(x, begins, sizes, symbols, length))
        if parts:
            doc, start, distance = (np.concatenate(p) for p in zip(*parts))
            order = np.lexsort((start, distance, doc))
            doc, start, distance = doc[order], start[order], distance[order]
            follows = (doc[1:] == doc[:-1]) & (distance[1:] == distance[:-1]) & (start[1:] == start[:-1] + length)
            head = np.append(True, ~follows)[: len(doc)]
            yield doc[head], start[head], distance[head]


def same_words(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading numbers are equal."""
    at, step = 0, 32
    while at < len(a):
        differ = a[at : at + step] != b[at : at + step]
        if differ.any():
            return at + int(differ.argmax())
        at += step
        step *= 2
    return len(a)


def is_smallest(stretch: np.ndarray, period: int) -> bool:
    """Whether no shorter period than ``period`` holds in a stretch of at least two periods of it.

    A shorter one would divide it, so it is enough to try it divided by each of its prime factors.
    """
    rest, factor = period, 2
    while rest > 1:
        if factor * factor > rest:
            factor = rest
        if rest % factor == 0:
            part = period // factor
            if np.array_equal(stretch[:period], stretch[part : part + period]):
                return False
            while rest % factor == 0:
                rest //= factor
        factor += 1
    return True


def numbered(words: list[bytes]) -> tuple[list[int], int]:
    """Each word's number in order of first occurrence, and how many different ones there are."""
    numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return list(map(numbers.__getitem__, words)), len(numbers)


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join(compress(words, keep.tolist()))


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exponent: int = 4, shortest: int = 6
) -> DataFrame:
    """``(id, n_words, runs, collapsed)`` for each row of ``docs``; a run is a struct of start, length and period in words."""
    if exponent < 3:
        raise ValueError("a run must be at least three periods long")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        finder = RunFinder(exponent, shortest)
        for whole in batches:
            for rows in slices(whole, "text", SLICE_BYTES):
                texts = [t.split() for t in text_bytes(rows.column("text"))]
                numbers = [numbered(words) for words in texts]
                sizes = np.array([len(words) for words in texts], np.int64)
                x = np.concatenate([np.zeros(0, np.uint64), *(np.array(n, np.uint64) for n, _ in numbers)])
                runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
                for doc, *run in finder.find(x, np.cumsum(sizes) - sizes, sizes, np.array([m for _, m in numbers], np.int64)):
                    runs[doc].append(tuple(run))
                flat = np.array([r for part in runs for r in part], np.int64).reshape(-1, 3)
                structs = pa.StructArray.from_arrays([pa.array(c) for c in np.ascontiguousarray(flat.T)], names=["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("id"),
                        pa.array(sizes),
                        pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, runs)]), pa.int32()), structs),
                        pa.array([collapse(w, r) for w, r in zip(texts, runs)], pa.binary()).cast(pa.string()),
                    ],
                    names=["id", "n_words", "runs", "collapsed"],
                )

    return arrow_map(id_and_text(docs, id_col, text_col), found, SCHEMA)
