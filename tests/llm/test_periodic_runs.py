"""Runs of repeated words against brute force, the transforms by hand, and the registered query on a whole table."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from spectral_topics.llm import periodic_runs
from spectral_topics.llm.queries import QUERIES
from tests.llm.conftest import DOCUMENTS, LONG


def runs_by_hand(words, exponent=4, shortest=6):
    numbers = np.unique(np.array(words, object), return_inverse=True)[1] if words else np.zeros(0, int)
    n, found = len(words), []
    for q in range(1, n // exponent + 1):
        edges = np.diff(np.concatenate(([0], (numbers[:-q] == numbers[q:]).astype(int), [0])))
        for start, end in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) + q):
            if end - start >= max(shortest, exponent * q):
                if not any((numbers[start : end - r] == numbers[start + r : end]).all() for r in range(1, q)):
                    found.append((int(start), int(end - start), q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed_by_hand(words, runs):
    gone = {i for start, length, period in runs for i in range(start + period, start + length)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def find(finder, documents):
    parts = [periodic_runs.numbered(d) for d in documents]
    sizes = np.array([len(d) for d in documents])
    x = np.concatenate([np.zeros(0, np.uint64), *(np.array(n, np.uint64) for n, _ in parts)])
    out = [[] for _ in documents]
    for doc, *run in finder.find(x, np.cumsum(sizes) - sizes, sizes, np.array([m for _, m in parts])):
        out[doc].append(tuple(run))
    return out


def messy(rng):
    words = [rng.randrange(3) for _ in range(rng.randrange(60))]
    kinds = rng.choice([1, 2, 3, 40])
    while rng.random() < 0.85:
        pattern = [rng.randrange(kinds) for _ in range(rng.randrange(1, 14))]
        words += (pattern * rng.randrange(1, 9))[: rng.randrange(1, 90)]
    return [b"%d" % w for w in words]


@pytest.mark.parametrize("exponent, shortest", [(4, 6), (3, 1), (5, 20)])
def test_runs_of_messy_documents(exponent, shortest):
    rng = random.Random(exponent)
    finder = periodic_runs.RunFinder(exponent, shortest)
    for _ in range(40):
        documents = [messy(rng) for _ in range(12)]
        for words, found in zip(documents, find(finder, documents)):
            assert found == runs_by_hand(words, exponent, shortest)


def test_small_arrays_and_several_primes(monkeypatch):
    """Blocks are split over many arrays; sums beyond one prime or two need the next one."""
    monkeypatch.setattr(periodic_runs, "CELLS", 8)
    monkeypatch.setattr(periodic_runs, "PRIMES", ((7681, 17), (12289, 11), *periodic_runs.PRIMES))
    rng = random.Random(5)
    documents = [messy(rng) + [b"w%d" % i for i in range(400)] + [b"x"] * rng.randrange(9) for _ in range(6)]
    for words, found in zip(documents, find(periodic_runs.RunFinder(), documents)):
        assert found == runs_by_hand(words)


def test_transform_multiplies_polynomials():
    rng = np.random.default_rng(1)
    for prime, root in periodic_runs.PRIMES:
        for size in (2, 8, 64):
            t = periodic_runs.Transform(size, prime, root)
            a, b = rng.integers(0, prime, (2, size, 3), np.uint64)
            found = t.inverse(t.times(t.forward(a), t.forward(b)))
            for c in range(3):
                expected = [0] * size
                for i in range(size):
                    for j in range(size):
                        expected[(i + j) % size] += int(a[i, c]) * int(b[j, c])
                assert found[:, c].tolist() == [e % prime for e in expected]


def test_long_repeats_take_little_work():
    """One word, and one period of 999 words, repeated over 100,000 words."""
    finder = periodic_runs.RunFinder()
    assert find(finder, [[b"a"] * 100_000]) == [[(0, 100_000, 1)]]
    words = [b"head"] + [b"%d" % (i % 999) for i in range(100_000)]
    assert find(finder, [words]) == [[(1, 100_000, 999)]]


def test_operator_on_messy_documents(docs, no_docs):
    found = {(r["id"], r["n_words"], r["collapsed"]): [tuple(x) for x in r["runs"]] for r in periodic_runs.periodic_runs(docs).collect()}
    expected = {}
    for i, text, _, _ in DOCUMENTS:
        words = (text or "").encode().split()
        runs = runs_by_hand(words) if text != LONG else [(0, len(words), 5)]
        expected[i, len(words), collapsed_by_hand(words, runs).decode()] = runs
    assert found == expected
    assert periodic_runs.periodic_runs(docs).count() == len(DOCUMENTS)
    assert periodic_runs.periodic_runs(no_docs).collect() == []
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(docs, exponent=2)


def test_query_on_a_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    found = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op11_periodic_runs"](spark, sf).collect()}
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(texts)
    for doc, text in texts:
        words, h = (text or "").encode().split(), zlib.crc32(str(doc).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = runs_by_hand(words)
        top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        digests = hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed_by_hand(words, runs)).hexdigest()
        assert found[doc] == (len(runs), *best, *digests)
