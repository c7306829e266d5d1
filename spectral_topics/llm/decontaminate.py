"""Benchmark decontamination with an FM-index per training shard.

Test items are cut into windows of ``window`` consecutive words (an item of fewer words is one
window). Every task takes its documents in shards of about ``SHARD_BYTES``, builds an FM-index of
each shard's words, searches all windows backwards through wavelet-tree ranks, locates their
occurrences by sampled suffix positions, and merges the words they cover into spans. Only stretches
of words that test items have, at least as long as the shortest window, are put into the index: no
window can lie elsewhere. Documents never leave their task, so nothing is shuffled.

The windows are broadcast. A benchmark larger than ``CHUNK_BYTES`` is dealt into chunks by the hash
of its items; each chunk is one more pass over the shards inside the same tasks, and spans of all
passes are merged, so what is broadcast at a time is bounded.

Defined results
- A null text has no words. An item without words has no window; a null item id is the empty text.
- Rows of the benchmark that repeat an id are one item with the windows of all of them.
- Repeated documents give repeated rows. An empty table gives an empty result; an empty benchmark hits nothing.
- Other columns are kept by ``mark_contamination`` and ``remove_contamination``, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectral_topics.llm.common import arrow_map, forget, id_and_text, quoted, text_bytes
from spectral_topics.llm.fm_index import FMIndex

WINDOW = 10
SHARD_BYTES = 16 << 20
#: Items' text broadcast at a time, at most; a single longer item is a chunk of its own.
CHUNK_BYTES = 32 << 20

#: Words are runs of digits, a-z and bytes of characters beyond ASCII; all other bytes separate.
BLANKS = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
HITS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
HITS_SQL = "array<struct<start: long, end: long>>"


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(BLANKS).split()


@dataclass
class Phrases:
    """Windows of test items as symbol rows, by length, and the items that have them."""

    symbols: dict[bytes, int]
    by_length: dict[int, np.ndarray]
    #: For each length, the items of each window: offsets and item numbers.
    owners: dict[int, tuple[np.ndarray, np.ndarray]]
    items: list[str]


def phrases(items: list[tuple[str, bytes]], window: int = WINDOW) -> Phrases:
    symbols: dict[bytes, int] = {}
    names = sorted({name for name, _ in items})
    number = {name: i for i, name in enumerate(names)}
    windows: dict[int, dict[tuple[int, ...], set[int]]] = defaultdict(lambda: defaultdict(set))
    for name, text in items:
        coded = tuple(symbols.setdefault(w, len(symbols) + 1) for w in words_of(text))
        length = min(window, len(coded))
        for i in range(len(coded) - length + 1 if length else 0):
            windows[length][coded[i : i + length]].add(number[name])
    by_length, owners = {}, {}
    for length, found in sorted(windows.items()):
        by_length[length] = np.array(list(found), np.int64).reshape(-1, length)
        counts = [len(x) for x in found.values()]
        owners[length] = (np.concatenate(([0], np.cumsum(counts))), np.array([i for x in found.values() for i in sorted(x)], np.int64))
    return Phrases(symbols, by_length, owners, names)


def search_shard(texts: list[bytes], wanted: Phrases) -> tuple[list[list[tuple[int, int]]], list[list[str]], list[int]]:
    """For each text its hit spans (word numbers, end exclusive), the items that occur, and its number of words."""
    known = wanted.symbols.get
    coded, counts = [], []
    for text in texts:
        words = words_of(text)
        counts.append(len(words))
        coded.append(np.fromiter((known(w, 0) for w in words), np.int64, len(words)))
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[list[str]] = [[] for _ in texts]
    if not wanted.by_length:
        return spans, items, counts
    # One sequence, a separator after each document; a place in it is a word of one document.
    starts = np.concatenate(([0], np.cumsum([n + 1 for n in counts])))
    whole = np.zeros(starts[-1], np.int64)
    for at, c in zip(starts, coded, strict=False):
        whole[at : at + len(c)] = c
    kept = long_stretches(whole, min(wanted.by_length))
    if not len(kept):
        return spans, items, counts
    index = FMIndex(whole[kept], len(wanted.symbols))
    changes = np.zeros(len(whole) + 1, np.int64)
    pairs = []
    for length, rows in wanted.by_length.items():
        low, high = index.search(rows)
        n = high - low
        found = np.flatnonzero(n)
        pattern = np.repeat(found, n[found])
        offset = np.arange(len(pattern)) - np.repeat(np.cumsum(n[found]) - n[found], n[found])
        places = kept[index.locate(low[pattern] + offset)]
        np.add.at(changes, places, 1)
        np.add.at(changes, places + length, -1)
        doc = np.searchsorted(starts, places, side="right") - 1
        seen = np.unique(np.stack((doc, pattern), axis=1), axis=0)
        offsets, owner = wanted.owners[length]
        per = offsets[seen[:, 1] + 1] - offsets[seen[:, 1]]
        inner = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        pairs.append(np.stack((np.repeat(seen[:, 0], per), owner[np.repeat(offsets[seen[:, 1]], per) + inner]), axis=1))
    for doc, item in np.unique(np.concatenate(pairs), axis=0).tolist():
        items[doc].append(wanted.items[item])
    hit = np.concatenate(([0], (np.cumsum(changes[:-1]) > 0).astype(np.int8), [0]))
    edges = np.flatnonzero(np.diff(hit))
    for a, b in edges.reshape(-1, 2).tolist():
        doc = int(np.searchsorted(starts, a, side="right")) - 1
        spans[doc].append((a - int(starts[doc]), b - int(starts[doc])))
    return spans, items, counts


def long_stretches(s: np.ndarray, least: int) -> np.ndarray:
    """Places of all stretches of at least ``least`` symbols without a 0, each with the 0 behind it."""
    inside = np.concatenate(([0], (s > 0).astype(np.int8), [0]))
    edges = np.flatnonzero(np.diff(inside)).reshape(-1, 2)
    edges = edges[edges[:, 1] - edges[:, 0] >= least]
    size = edges[:, 1] - edges[:, 0] + 1
    return np.repeat(edges[:, 0] - (np.cumsum(size) - size), size) + np.arange(size.sum()) if len(edges) else np.zeros(0, np.int64)


def merged(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of two lists of spans; those that touch become one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(a + b):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def benchmark_chunks(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list[tuple[str, bytes]]]:
    """Items in chunks of about ``limit`` bytes of text."""
    rows = benchmark.select(
        F.coalesce(quoted(id_col).cast("string"), F.lit("")).alias("id"), F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("text")
    )
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // limit))
    for k in range(n):
        found = rows.where(F.pmod(F.xxhash64("id"), F.lit(n)) == k).toArrow()
        yield list(zip(found.column("id").to_pylist(), text_bytes(found.column("text").combine_chunks()), strict=True))


def mark_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    names: tuple[str, str, str] = ("n_words", "hits", "items"),
    chunk_bytes: int = CHUNK_BYTES,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """``docs`` with three more columns called ``names``: number of words, hit spans in words, items that occur."""
    if set(names) & set(docs.columns):
        raise ValueError(f"the documents have columns of the names {names} already")
    schema = ", ".join([f"`{names[0]}` long", f"`{names[1]}` {HITS_SQL}", f"`{names[2]}` array<string>"])

    def marked(rows: pa.RecordBatch, counts: list, spans: list, items: list) -> pa.RecordBatch:
        hits = pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], HITS)
        columns = [*rows.columns, pa.array(counts, pa.int64()), hits, pa.array(items, pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(columns, names=[*rows.schema.names, *names])

    chunks = benchmark_chunks(benchmark, item_col, item_text_col, chunk_bytes)
    return _searched(docs, chunks, text_col, window, shard_bytes, marked, _with(docs, schema))


def _searched(docs: DataFrame, chunks: Iterator[list[tuple[str, bytes]]], text_col: str, window: int, shard_bytes: int, made, schema) -> DataFrame:
    """What ``made`` gives for each shard of rows, its texts' numbers of words, their hit spans, and the items that occur.

    One Python step, however many chunks: each step of a stage has a worker process of its own for every task, and
    idle ones stay and take part in all later work, with a memory of remembered words each.
    """
    place = docs.columns.index(text_col)
    shared = [docs.sparkSession.sparkContext.broadcast(phrases(chunk, window)) for chunk in chunks]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for rows in shards(batches, place, shard_bytes):
            texts = text_bytes(rows.column(place))
            spans, items, counts = search_shard(texts, shared[0].value)
            for chunk in shared[1:]:
                more, others, _ = search_shard(texts, chunk.value)
                spans = [merged(a, b) for a, b in zip(spans, more, strict=True)]
                items = [sorted({*a, *b}) for a, b in zip(items, others, strict=True)]
            yield made(rows, counts, spans, items)

    return arrow_map(docs, search, schema)


def _with(docs: DataFrame, more: str):
    from pyspark.sql.types import StructType, _parse_datatype_string

    return StructType([*docs.schema.fields, *_parse_datatype_string(more).fields])


def shards(batches: Iterator[pa.RecordBatch], place: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Batches put together, or cut, to about ``limit`` bytes of text each."""
    held: list[pa.RecordBatch] = []
    size = 0
    for rows in batches:
        lengths = np.fromiter(map(len, text_bytes(rows.column(place))), np.int64, rows.num_rows)
        at = 0
        while at < rows.num_rows:
            fits = int(np.searchsorted(np.cumsum(lengths[at:]), max(1, limit - size), side="left")) + 1
            part = rows.slice(at, fits)
            held.append(part)
            size += int(lengths[at : at + fits].sum())
            at += part.num_rows
            if size >= limit:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``(id, n_words, hits, items)`` for each row of ``docs``."""
    found = mark_contamination(id_and_text(docs, id_col, text_col), benchmark, "text", **options)
    return found.drop("text")


def remove_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    chunk_bytes: int = CHUNK_BYTES,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """``docs`` with the hit spans cut out of the text; rows of which no word is left are dropped, if they had a hit."""
    place = docs.columns.index(text_col)

    def cut(rows: pa.RecordBatch, counts: list, spans: list, items: list) -> pa.RecordBatch:
        texts = rows.column(place).to_pylist()
        stay = np.ones(rows.num_rows, bool)
        for i, found in enumerate(spans):
            if found:
                stay[i] = sum(b - a for a, b in found) < counts[i]
                texts[i] = without_spans(texts[i].encode(), found).decode("utf-8", "replace")
        columns = list(rows.columns)
        columns[place] = pa.array(texts, rows.schema.field(place).type)
        return pa.RecordBatch.from_arrays(columns, names=rows.schema.names).filter(pa.array(stay))

    chunks = benchmark_chunks(benchmark, item_col, item_text_col, chunk_bytes)
    return _searched(docs, chunks, text_col, window, shard_bytes, cut, docs.schema)


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what lies between them."""
    inside = np.frombuffer(text.lower().translate(BLANKS), np.uint8) != 0x20
    edges = np.flatnonzero(np.diff(np.concatenate(([0], inside.astype(np.int8), [0])))).reshape(-1, 2)
    kept, at = [], 0
    for first, end in spans:
        kept.append(text[at : edges[first, 0]])
        at = int(edges[end - 1, 1])
    return b"".join([*kept, text[at:]])
