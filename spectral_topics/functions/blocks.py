"""Sums over blocked tokens in numpy, for models that are fetched by block.

A block's tokens and the model rows of its words meet as two Arrow tables. A token finds its row by binary search and
columns are added up one at a time, so neither the tokens nor the rows are sorted or joined by Spark. A task
holds one block, which has a bounded number of tokens, and a row of the model for each of its words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectral_topics.functions.batches import one_thread
from spectral_topics.functions.columns import named


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    return pc.fill_null(column, 0.0).to_numpy()


class _Block:
    """One block: tokens in order of document, and for each its place among the block's words."""

    def __init__(self, docs: np.ndarray, words: np.ndarray, cnt: np.ndarray, model: pa.Table, cols: Sequence[str]) -> None:
        model = model.filter(pc.is_valid(model.column(cols[0])))
        known = model.column("word_id").to_numpy()
        order = np.argsort(known)
        self.words = known[order]
        self.columns = [_numbers(model.column(c))[order] for c in cols]
        at = np.searchsorted(self.words, words)
        missing = at == len(self.words)
        missing[~missing] = self.words[at[~missing]] != words[~missing]
        if missing.any():
            raise ValueError(f"no row in the model for word id {words[missing][0]}")
        if (docs[1:] < docs[:-1]).any():
            rows = np.argsort(docs, kind="stable")
            docs, at, cnt = docs[rows], at[rows], cnt[rows]
        self.at, self.cnt = at, cnt
        self.heads = np.flatnonzero(np.append(True, docs[1:] != docs[:-1])[: len(docs)])
        self.sizes = np.diff(np.append(self.heads, len(docs)))
        self.length = self._by_document(cnt)

    def _by_document(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.heads) if len(self.heads) else np.zeros(0)

    def projections(self) -> Iterator[np.ndarray]:
        """Sums of cnt * model row by document, a column at a time."""
        return (self._by_document(self.cnt * column[self.at]) for column in self.columns)


def _together(blocks: DataFrame, fetched: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    one_thread(blocks)
    # Rows fetched for words of these tokens carry columns of theirs, which a cogroup can't tell apart without new names.
    right = fetched.select(*[F.col(c).alias(c) for c in fetched.columns]).groupBy("block")
    return blocks.groupBy("block").cogroup(right).applyInArrow(run, schema)


def document_totals(tokens: DataFrame, fetched: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(doc_id, len, x0, ...)``: sums of cnt, and of cnt * model row, by document of blocked tokens.

    ``fetched(block, word_id, cols...)`` has the model row of each word in each block, partitioned as the tokens are.
    """
    xs = named("x", len(cols))

    def run(docs: pa.Table, model: pa.Table) -> pa.Table:
        lists = docs.column("tokens").combine_chunks()
        words, cnt = (pa.chunked_array([part]) for part in lists.flatten().flatten())
        rows = np.repeat(np.arange(docs.num_rows), pc.list_value_length(lists).to_numpy())
        block = _Block(rows, words.to_numpy(), _numbers(cnt), model, cols)
        return pa.table([docs.column("doc_id"), block.length, *block.projections()], names=["doc_id", "len", *xs])

    id_type = tokens.schema["doc_id"].dataType.simpleString()
    whole = tokens.groupBy("block", "doc_id").agg(F.collect_list(F.struct("word_id", "cnt")).alias("tokens"))
    return _together(whole, fetched, run, ", ".join([f"doc_id {id_type}, len double", *[f"{x} double" for x in xs]]))


def word_totals(
    tokens: DataFrame,
    fetched: DataFrame,
    cols: Sequence[str],
    names: Sequence[str],
    least: float,
    weigh: Callable[[np.ndarray], Sequence[np.ndarray]],
) -> DataFrame:
    """``(word_id, names..., x0, ...)`` per block and word, over documents of ``least`` words or more.

    ``weigh`` gives documents' weights by their lengths: one for each name, whose sums are of cnt * weight, and a last one
    for the sums of cnt * weight * x, x being the projected document. Sum the result by word.
    """
    names, xs = list(names), named("x", len(cols))

    def run(tokens: pa.Table, model: pa.Table) -> pa.Table:
        ids = tokens.column("doc_id").combine_chunks()
        # An integer stands for itself, any other id for its place among the ids.
        docs = ids.to_numpy() if pa.types.is_integer(ids.type) else ids.dictionary_encode().indices.to_numpy()
        block = _Block(docs, tokens.column("word_id").to_numpy(), _numbers(tokens.column("cnt")), model, cols)
        used = block.length >= least
        weights = [np.zeros(len(used)) for _ in range(len(names) + 1)]
        for weight, found in zip(weights, weigh(block.length[used])):
            weight[used] = found
        counted = np.repeat(used, block.sizes)
        at, cnt = block.at[counted], block.cnt[counted]
        sizes = block.sizes[used]

        def by_word(of_document: np.ndarray) -> np.ndarray:
            return np.bincount(at, cnt * np.repeat(of_document[used], sizes), len(block.words))

        present = np.bincount(at, minlength=len(block.words)) > 0
        sums = [by_word(w)[present] for w in weights[:-1]] + [by_word(weights[-1] * x)[present] for x in block.projections()]
        return pa.table([block.words[present], *sums], names=["word_id", *names, *xs])

    id_type = tokens.schema["word_id"].dataType.simpleString()
    rows = tokens.select("block", "doc_id", "word_id", "cnt")
    return _together(rows, fetched, run, ", ".join([f"word_id {id_type}", *[f"{n} double" for n in [*names, *xs]]]))
