"""Sums of weighted vectors by key, as numpy segments of Arrow batches.

Generated code adds up a wide row column by column, which beyond about a hundred columns is no longer compiled. Here
a vector is one ARRAY<DOUBLE> column ``vec`` and rows arrive sorted by key, so a sum is ``np.add.reduceat`` over stretches of
a batch; what is open at the end of a batch is carried into the next. A task holds one batch, the words and counts of
one document, and at most ``HELD_CELLS`` sums. A null cell or weight adds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectral_topics.functions.batches import arrow_batches

# Numbers multiplied at once, and sums that a task keeps before it sends them on.
PIECE_CELLS = 1 << 20
HELD_CELLS = 1 << 23
SPLIT = "the tokens of a document are not together in one partition"


def _numbers(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column, 0.0).to_numpy(zero_copy_only=False)


def _vectors(rows: pa.RecordBatch, width: int) -> np.ndarray:
    return _numbers(rows.column("vec").flatten()).reshape(rows.num_rows, width)


def _pieces(batches: Iterator[pa.RecordBatch], width: int, cells: int) -> Iterator[pa.RecordBatch]:
    step = max(1, cells // width)
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def _heads(key: pa.Array) -> np.ndarray:
    """Where each stretch of equal keys begins; nulls are equal to each other."""
    here, before = key.slice(1), key.slice(0, len(key) - 1)
    differs = pc.or_(pc.fill_null(pc.not_equal(here, before), False), pc.not_equal(pc.is_null(here), pc.is_null(before)))
    return np.append(0, 1 + np.flatnonzero(differs.to_numpy(zero_copy_only=False)))


def _batch(key: str, keys: pa.Array, names: Sequence[str], sums: np.ndarray) -> pa.RecordBatch:
    """The first sums are the named ones, the others the vector."""
    width = sums.shape[1] - len(names)
    flat = np.ascontiguousarray(sums[:, len(names) :]).ravel()
    vec = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1, dtype=np.int32) * width), pa.array(flat))
    return pa.record_batch([keys, *[pa.array(sums[:, i]) for i in range(len(names))], vec], names=[key, *names, "vec"])


def _schema(df: DataFrame, key: str, names: Sequence[str]) -> str:
    scalars = "".join(f"{n} double, " for n in names)
    return f"{key} {df.schema[key].dataType.simpleString()}, {scalars}vec array<double>"


def sum_sorted(df: DataFrame, key: str, scalars: Sequence[str], width: int, weight: str | None = None) -> DataFrame:
    """``(key, scalars..., vec)``: sums of the scalars and of weight * vec over stretches of equal keys in each partition."""
    rows = df.select(key, *dict.fromkeys([*scalars, *([weight] if weight else [])]), "vec")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, None
        for part in _pieces(batches, width, PIECE_CELLS):
            keys, vec = part.column(key), _vectors(part, width)
            if weight:
                vec = vec * _numbers(part.column(weight))[:, None]
            heads = _heads(keys)
            sums = np.add.reduceat(np.column_stack([*[_numbers(part.column(s)) for s in scalars], vec]), heads, axis=0)
            if carried is not None:
                if last[0].equals(keys[0]):
                    sums[0] += carried[0]
                else:
                    yield _batch(key, last, scalars, carried)
            if len(heads) > 1:
                yield _batch(key, keys.take(pa.array(heads[:-1])), scalars, sums[:-1])
            last, carried = keys.take(pa.array(heads[-1:])), sums[-1:].copy()
        if carried is not None:
            yield _batch(key, last, scalars, carried)

    return arrow_batches(rows, add, _schema(df, key, scalars))


def sum_by_key(df: DataFrame, key: str, scalars: Sequence[str], width: int, weight: str | None = None, summed: bool = False) -> DataFrame:
    """``sum_sorted`` over the whole table: summed within partitions (unless ``summed`` says it is), then after one shuffle."""
    if not summed:
        df = sum_sorted(df.sortWithinPartitions(key), key, scalars, width, weight)
    return sum_sorted(df.repartition(key).sortWithinPartitions(key), key, scalars, width)


class _WordSums:
    """Sums by word of what documents give their words, sent on when too many are held."""

    def __init__(self, names: Sequence[str], word_type: pa.DataType, piece: int, most: int) -> None:
        self.names, self.word_type, self.piece, self.most = names, word_type, piece, most
        self.words: list[np.ndarray] = []
        self.sums: list[np.ndarray] = []
        self.cells = 0

    def add(self, words: np.ndarray, cnt: np.ndarray, weights: np.ndarray, x: np.ndarray, doc: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Token t gives its word cnt * weight for each weight, and the last of these times row ``doc[t]`` of x."""
        step = max(1, self.piece // x.shape[1])
        for at in range(0, len(words), step):
            part = slice(at, at + step)
            given = cnt[part, None] * weights[doc[part]]
            self._keep(*_sum_by(words[part], np.hstack([given[:, :-1], given[:, -1:] * x[doc[part]]])))
            if self.cells > self.most:
                self._merge()
                if self.cells > self.most // 2:
                    yield from self.send()

    def _keep(self, words: np.ndarray, sums: np.ndarray) -> None:
        self.words.append(words)
        self.sums.append(sums)
        self.cells += sums.size

    def _merge(self) -> None:
        words, sums = np.concatenate(self.words), np.concatenate(self.sums)
        self.words, self.sums, self.cells = [], [], 0
        self._keep(*_sum_by(words, sums))

    def send(self) -> Iterator[pa.RecordBatch]:
        if not self.words:
            return
        self._merge()
        words, sums = self.words.pop(), self.sums.pop()
        self.cells = 0
        step = max(1, self.piece // sums.shape[1])
        for at in range(0, len(words), step):
            yield _batch("word_id", pa.array(words[at : at + step], self.word_type), self.names, sums[at : at + step])


def _sum_by(words: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(words, kind="stable")
    words = words[order]
    heads = np.flatnonzero(np.append(True, words[1:] != words[:-1]))
    return words[heads], np.add.reduceat(sums[order], heads, axis=0)


def _token_arrays(rows: pa.RecordBatch, weights: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words = rows.column("word_id").to_numpy(zero_copy_only=False)
    return words, _numbers(rows.column("cnt")), np.column_stack([_numbers(rows.column(w)) for w in weights])


def words_of_documents(tokens: DataFrame, weights: Sequence[str], names: Sequence[str], width: int) -> DataFrame:
    """Partial sums ``(word_id, names..., vec)`` over documents whose tokens follow each other in one partition.

    ``tokens(doc_id, n, word_id, cnt, weights..., vec)``, sorted by document: a document's x is the sum of cnt * vec,
    and each of its tokens gives its word cnt * weight for all weights but the last, and cnt * last weight * x.
    Tokens without a last weight count for nothing. A document whose stretch does not have its n tokens fails the job.
    """
    rows = tokens.select("doc_id", "n", "word_id", "cnt", *weights, "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = tail = None
        for part in _pieces(batches, width, PIECE_CELLS):
            part = part.filter(pc.is_valid(part.column(weights[-1])))
            if not part.num_rows:
                continue
            totals = totals or _WordSums(names, part.column("word_id").type, PIECE_CELLS, HELD_CELLS)
            keys, heads = part.column("doc_id"), _heads(part.column("doc_id"))
            words, cnt, given = _token_arrays(part, weights)
            wanted = part.column("n").to_numpy(zero_copy_only=False)[heads]
            x = np.add.reduceat(_vectors(part, width) * cnt[:, None], heads, axis=0)
            ends = np.append(heads[1:], len(words))
            joins = int(tail is not None and tail.key.equals(keys[0]))
            if joins:
                tail.extend(words[: ends[0]], cnt[: ends[0]], x[0])
            if len(heads) == joins:
                continue
            if tail is not None:
                yield from tail.give(totals)
            if (wanted != ends - heads)[joins:-1].any():
                raise RuntimeError(SPLIT)
            doc = np.repeat(np.arange(len(heads)), ends - heads)
            closed = slice(heads[joins], heads[-1])
            yield from totals.add(words[closed], cnt[closed], given[heads], x, doc[closed])
            tail = _Tail(keys[len(keys) - 1], words[heads[-1] :], cnt[heads[-1] :], given[heads[-1]], x[-1], wanted[-1])
        if tail is not None:
            yield from tail.give(totals)
            yield from totals.send()

    return arrow_batches(rows, run, _schema(tokens, "word_id", names))


class _Tail:
    """The document that is open at the end of a batch."""

    def __init__(self, key: pa.Scalar, words: np.ndarray, cnt: np.ndarray, weights: np.ndarray, x: np.ndarray, wanted: int) -> None:
        self.key, self.words, self.cnt, self.weights, self.x = key, [words.copy()], [cnt.copy()], weights.copy(), x.copy()
        self.wanted = wanted

    def extend(self, words: np.ndarray, cnt: np.ndarray, x: np.ndarray) -> None:
        self.words.append(words.copy())
        self.cnt.append(cnt.copy())
        self.x += x

    def give(self, totals: _WordSums) -> Iterator[pa.RecordBatch]:
        words = np.concatenate(self.words)
        if len(words) != self.wanted:
            raise RuntimeError(SPLIT)
        yield from totals.add(words, np.concatenate(self.cnt), self.weights[None], self.x[None], np.zeros(len(words), np.int64))


def words_of_vectors(tokens: DataFrame, weights: Sequence[str], names: Sequence[str], width: int) -> DataFrame:
    """As ``words_of_documents``, for tokens in any order whose ``vec`` is the x of their document."""
    rows = tokens.select("word_id", "cnt", *weights, "vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = None
        for part in _pieces(batches, width, PIECE_CELLS):
            part = part.filter(pc.is_valid(part.column(weights[-1])))
            totals = totals or _WordSums(names, part.column("word_id").type, PIECE_CELLS, HELD_CELLS)
            yield from totals.add(*_token_arrays(part, weights), _vectors(part, width), np.arange(part.num_rows))
        if totals is not None:
            yield from totals.send()

    return arrow_batches(rows, run, _schema(tokens, "word_id", names))


def vec_cells(width: int, vec: str = "vec") -> list:
    return [F.col(vec)[j] for j in range(width)]
