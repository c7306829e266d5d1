"""Words of texts as numbered tokens, without a shuffle of each document's words.

Neighbouring documents form a slice, whose distinct spellings are coded there. Only spellings are then looked up by word:
once per slice, however many documents have them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of the texts that are taken together; a single text of more is a slice of its own.
SLICE_WORDS = 4_000_000
#: Which bytes of an ASCII text are letters.
LETTERS = np.array([chr(b).isalpha() for b in range(128)] + [False] * 128)


def text_words(text: str = "text") -> tuple[Column, Column]:
    """``words`` and ``plain`` for ``slices``: runs of letters, found by Spark, or the whole of an ASCII text, to be cut there."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    found = F.regexp_extract_all(text, F.lit(r"\p{L}+"), F.lit(0))
    return F.when(~ascii_only, found).alias("words"), F.when(ascii_only, F.col(text)).alias("plain")


def runs_of_letters(texts: pa.Array) -> pa.ListArray:
    """The runs of letters of each ASCII text; a null has none."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    letter = LETTERS[data]
    # A run begins at a letter behind another character or at the start of a text, and ends likewise.
    cut = np.zeros(len(data) + 1, bool)
    cut[ends] = True
    outside = np.concatenate(([True], ~letter, [True]))
    first = np.flatnonzero(letter & (outside[:-2] | cut[:-1]))
    last = np.flatnonzero(letter & (outside[2:] | cut[1:]))
    places = np.append(0, np.cumsum(last + 1 - first)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(first), pa.py_buffer(places), pa.py_buffer(data[letter]))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(first, ends).astype(np.int32)), words)


def slices(docs: DataFrame, size: int = SLICE_WORDS) -> DataFrame:
    """``docs(doc_id, words)`` in slices of neighbours: ``(slice, doc_id, codes, cnts, spellings)``.

    A column ``plain`` may hold ASCII texts of rows without words (``text_words``); their words are found here.

    A document has the codes of its distinct words, ascending, and how often each occurs. One more row per slice, without
    a document, has the slice's spellings; a code is a place in them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, number, held, words = TaskContext.get().partitionId() << 32, 0, [], 0
        for batch in batches:
            if "plain" in batch.schema.names:
                given = batch.column("words")
                every = pc.coalesce(given, runs_of_letters(batch.column("plain")).cast(given.type))
                batch = pa.record_batch([batch.column("doc_id"), every], names=["doc_id", "words"])
            lengths = pc.fill_null(pc.list_value_length(batch.column("words")), 0).to_numpy(zero_copy_only=False)
            ends, start = np.cumsum(lengths), 0
            for i in range(batch.num_rows):
                here = int(ends[i] - (ends[start - 1] if start else 0))
                if words + here > size and (held or i > start):
                    held.append(batch.slice(start, i - start))
                    yield from _slice(first + number, held)
                    number, held, words, start = number + 1, [], 0, i
            held.append(batch.slice(start))
            words += int(lengths[start:].sum())
        yield from _slice(first + number, held)

    schema = f"slice long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, codes array<int>, cnts array<int>, spellings array<string>"
    return docs.mapInArrow(run, schema)


def _slice(number: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs = pa.Table.from_batches(held).combine_chunks() if held else None
    if docs is None or not docs.num_rows:
        return
    lists = docs.column("words").combine_chunks()
    ids = docs.column("doc_id").combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    known = lists.flatten().dictionary_encode()
    at, cnt = counted(np.repeat(np.arange(len(lengths)), lengths), known.indices.to_numpy(), max(1, len(known.dictionary)))
    ends = np.searchsorted(at[0], np.arange(len(lengths) + 1)).astype(np.int32)
    codes, cnts = (pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (at[1], cnt))
    names = ["slice", "doc_id", "codes", "cnts", "spellings"]
    none = pa.nulls(len(ids), pa.list_(pa.string()))
    yield pa.record_batch([pa.array(np.full(len(ids), number)), ids, codes, cnts, none], names=names)
    spellings = pa.ListArray.from_arrays(pa.array([0, len(known.dictionary)], pa.int32()), known.dictionary.cast(pa.string()))
    absent = pa.nulls(1, pa.list_(pa.int32()))
    yield pa.record_batch([pa.array([number]), pa.nulls(1, ids.type), absent, absent, spellings], names=names)


def counted(major: np.ndarray, minor: np.ndarray, width: int, cnt: np.ndarray | None = None) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """The distinct pairs of two numbers, the second below ``width``, in order, and the sum of ``cnt`` (1 each) over each."""
    key = major.astype(np.int64) * width + minor
    if cnt is None:
        key.sort()
    else:
        order = np.argsort(key, kind="stable")
        key, cnt = key[order], cnt[order]
    heads = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    sums = np.diff(np.append(heads, len(key))) if cnt is None else np.add.reduceat(cnt, heads) if len(heads) else cnt
    return (key[heads] // width, key[heads] % width), sums


def numbered_slices(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``tokens(doc_id, word_id, cnt)`` of ``docs(slice, doc_id, codes, cnts)`` and ``ids(slice, code, word_id)``.

    Spellings of one word are added up.
    """

    def run(docs: pa.Table, ids: pa.Table) -> pa.Table:
        codes, cnts = (docs.column(c).combine_chunks() for c in ("codes", "cnts"))
        rows = np.repeat(np.arange(docs.num_rows), pc.list_value_length(codes).to_numpy())
        numbers = np.zeros(ids.num_rows, np.int64)
        numbers[ids.column("code").to_numpy()] = ids.column("word_id").to_numpy()
        words, place = np.unique(numbers, return_inverse=True)
        (doc, word), cnt = counted(rows, place[codes.flatten().to_numpy()], max(1, len(words)), cnts.flatten().to_numpy())
        found = docs.column("doc_id").combine_chunks().take(pa.array(doc))
        return pa.table([found, words[word], cnt.astype(float)], names=["doc_id", "word_id", "cnt"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, word_id long, cnt double"
    left = docs.select("slice", "doc_id", "codes", "cnts").groupBy("slice")
    return left.cogroup(ids.groupBy("slice")).applyInArrow(run, schema)
