"""Removal of repeated substrings with a distributed, sampled suffix array.

Every string of ``length`` bytes that also starts earlier (in a document of smaller id, or earlier in
the same one) is covered by a removal span; spans are judged on the input. Matches never cross documents.

1. Suffixes that start at anchors (suffix_sort.py: content-defined places, at least one in every
   string of ``length`` bytes) stand for all others. A sample of them gives splitters.
2. Each task cuts its texts into anchored suffixes. Of equal ones it keeps the earliest; the others'
   spans are final. The rest are dealt by the splitters into buckets of adjoining leading bytes.
   Suffixes of one anchor gram always fall into one bucket: splitters lie between grams, so
   nothing equal stands on both sides of a boundary.
3. Each bucket is sorted by multikey quicksort and neighbours are compared; where suffixes share an
   anchor but not all their surroundings, their strings are sorted in turn.
4. Spans are gathered by document and cut out.

Hot grams: a gram that would fill half a bucket (seen in the sample) is dealt in single strings, each
by its own leading bytes, instead of with its surroundings. So the contexts of a very common passage
spread over the buckets, and what all of them share is merged in each task before it is sent.

Text travels once in step 2 (compressed, unique stretches several times over) and once in step 4.

Defined results
- A null text is empty. A null id comes before all others. Texts shorter than ``length`` lose nothing.
- Rows of one id are told apart by the crc32 of their text, which also orders them; rows with the
  same id and text are one document listed twice and lose the same bytes.
- An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectral_topics.functions.storage import materialize
from spectral_topics.llm.common import arrow_map, forget, id_and_text, shuffles_deleted, text_bytes
from spectral_topics.llm.suffix_sort import (
    Records,
    Shape,
    equal_records,
    joined,
    merge_spans,
    records_of,
    repeated_strings,
)

#: Bytes of text whose places are hashed at once, and whose suffixes are compared before they are sent.
CHUNK = 1 << 20
GROUP = 4 << 20
#: Bytes of text for each bucket, and sampled suffixes for each. A task takes about 40 times as much
#: memory as its bucket has text; with larger executors take larger buckets.
BUCKET = 4 << 20
SAMPLES = 32
#: Bytes of text that are sampled, or not, together.
STRETCH = 8192
#: Suffixes of hot grams that a task spells out at once.
HOT_BLOCK = 4096
LEAST_ID = -(1 << 63)


def prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, doc, tie, text)``: doc and tie order documents and tell them apart."""
    rows = id_and_text(docs, id_col, text_col)
    return rows.select("id", F.coalesce("id", F.lit(LEAST_ID)).alias("doc"), F.crc32(F.col("text").cast("binary")).alias("tie"), "text")


def suffixes(batches: Iterator[pa.RecordBatch], shape: Shape) -> Iterator[Records]:
    """Records of about GROUP bytes of text at a time, by document and place."""
    forget()
    texts, docs, ties, offsets = [], [], [], []
    parts: list[Records] = []
    size = group = 0

    def flush() -> None:
        nonlocal size
        parts.append(records_of(texts, np.array(docs, np.int64), np.array(ties, np.int64), np.array(offsets, np.int64), shape))
        for x in (texts, docs, ties, offsets):
            x.clear()
        size = 0

    for rows in batches:
        for text, doc, tie in zip(text_bytes(rows.column("text")), rows.column("doc").to_pylist(), rows.column("tie").to_pylist(), strict=True):
            if len(text) < shape.length:
                continue
            # A long text is taken in stretches of starts; each has the bytes of all its strings.
            for at in range(0, len(text) - shape.length + 1, CHUNK):
                piece = text[at : at + CHUNK + shape.length - 1]
                texts.append(piece)
                docs.append(doc)
                ties.append(tie)
                offsets.append(at)
                size += len(piece)
                group += len(piece)
                if size >= CHUNK:
                    flush()
                if group >= GROUP:
                    yield joined(parts).in_order()
                    parts.clear()
                    group = 0
    if texts:
        flush()
    if parts:
        yield joined(parts).in_order()


def grams_of(records: Records, shape: Shape) -> np.ndarray:
    return np.ascontiguousarray(records.rows[:, shape.before : shape.before + shape.gram]).view(f"S{shape.gram}").ravel()


def stretches(rows: DataFrame, shape: Shape, part: float) -> DataFrame:
    """``(doc, tie, text)``: a share ``part`` of all stretches of STRETCH bytes, each with the bytes of all its strings."""
    raw = F.col("text").cast("binary")
    last = F.floor((F.length(raw) - shape.length) / STRETCH)
    chosen = F.filter(
        F.when(F.length(raw) >= shape.length, F.sequence(F.lit(0).cast("long"), last)),
        lambda at: F.pmod(F.xxhash64("doc", "tie", at), F.lit(1_000_000)) < int(part * 1_000_000),
    )
    spread = rows.select("doc", "tie", "text", F.explode(chosen).alias("at"))
    start = (F.col("at") * STRETCH + 1).cast("int")
    return spread.select("doc", "tie", F.substring(raw, start, F.lit(STRETCH + shape.length - 1)).alias("text"))


def splitters(rows: DataFrame, shape: Shape, buckets: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """``(bounds, hot)``: grams between buckets, and grams that would fill half a bucket.

    About SAMPLES grams for each bucket come to the driver, from stretches of texts chosen by the hash of document and
    place: a corpus of a few very long documents is sampled like one of many short ones.
    """
    wanted = SAMPLES * buckets
    expected = max(1.0, total * 2.0 / (shape.length - shape.gram + 2))
    part = min(1.0, max(16 * wanted / expected, 1e-4))
    step = max(1, int(part * expected / wanted))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for records in suffixes(batches, shape):
            kept = records.take(~equal_records(records, shape))
            grams = grams_of(kept, shape)[::step]
            yield pa.record_batch([pa.array([bytes(g) for g in grams], pa.binary())], names=["gram"])

    found = arrow_map(stretches(rows, shape, part), sample, "gram binary").toArrow().column("gram").to_pylist()
    grams = np.sort(np.array(found, f"S{shape.gram}"))
    if not len(grams):
        return grams, grams
    values, counts = np.unique(grams, return_counts=True)
    hot = values[counts >= SAMPLES // 2]
    even = np.linspace(0, len(grams), buckets + 1)[1:-1].astype(np.int64)
    return np.unique(grams[even]), hot


def pack(kind: str, *arrays: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps((kind, arrays), protocol=5))


def unpack(blob: bytes) -> tuple[str, tuple[np.ndarray, ...]]:
    import zstandard

    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def strings_of(records: Records, shape: Shape) -> Records:
    """A record for each string of the given ones, with no surroundings: its bytes stand where an anchor's do."""
    count = records.extra.astype(np.int64) + 1
    row = np.repeat(np.arange(len(records)), count)
    step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    offset = row * shape.width + shape.before - records.left[row].astype(np.int64) + step
    rows = np.zeros((len(row), shape.width), np.uint8)
    flat = np.ascontiguousarray(records.rows).ravel()
    if len(row):
        rows[:, shape.before : shape.before + shape.length] = np.lib.stride_tricks.sliding_window_view(flat, shape.length)[offset]
    none = np.zeros(len(row), np.uint8)
    return Records(rows, records.doc[row], records.tie[row], records.start[row] + step, none, none)


def repeated_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, bucket_bytes: int = BUCKET
) -> DataFrame:
    """``(doc, tie, start, end)``: stored spans to remove, in bytes; those of one document may overlap."""
    shape = Shape(length, min(28, max(8, length // 2)))
    rows = prepared(docs, id_col, text_col)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    spark = docs.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket_bytes))
    shared = spark.sparkContext.broadcast(splitters(rows, shape, buckets, total))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, hot = shared.value
        for records in suffixes(batches, shape):
            later = equal_records(records, shape)
            spans = [_span_arrays(records, later, shape)]
            kept = records.take(~later)
            grams = grams_of(kept, shape)
            common = np.isin(grams, hot)
            sending = [("suffix", kept.take(~common))]
            few = np.flatnonzero(common)
            for at in range(0, len(few), HOT_BLOCK):
                strings = strings_of(kept.take(few[at : at + HOT_BLOCK]), shape)
                again = equal_records(strings, shape)
                spans.append(_span_arrays(strings, again, shape))
                sending.append(("string", strings.take(~again)))
            out = []
            for kind, found in sending:
                where = np.searchsorted(bounds, grams_of(found, shape), side="right")
                order = np.argsort(where, kind="stable")
                heads = np.flatnonzero(np.diff(np.concatenate(([-1], where[order]))))
                for part in np.split(order, heads[1:]) if len(order) else []:
                    out.append((int(where[part[0]]), pack(kind, *(getattr(found.take(part), f) for f in Records.__dataclass_fields__))))
            local = merge_spans(*(np.concatenate(x) for x in zip(*spans, strict=True)))
            if len(local[0]):
                out.append((int(local[0][0]) % buckets, pack("spans", *local)))
            for at in range(0, len(out), 64):
                part = out[at : at + 64]
                yield pa.record_batch([pa.array([b for b, _ in part], pa.int32()), pa.array([x for _, x in part], pa.binary())], names=["bucket", "blob"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[Records]] = {"suffix": [], "string": []}
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                kind, arrays = unpack(blob)
                if kind == "spans":
                    yield _span_batch(arrays)
                else:
                    held[kind].append(Records(*arrays))
        # Strings of hot grams are compared among themselves: whoever has such a gram deals it in strings.
        for parts in held.values():
            if parts:
                records = joined(parts)
                parts.clear()
                yield _span_batch(merge_spans(*repeated_strings(records, shape)))

    dealt = arrow_map(rows, deal, "bucket int, blob binary").repartitionById(buckets, "bucket")
    found = arrow_map(dealt.select("blob"), sort, "doc long, tie long, start long, end long")
    # The suffixes' shuffle is the largest there is: its files go before the texts' begins.
    with shuffles_deleted(spark):
        return materialize(found, "repeats")


def _span_arrays(records: Records, which: np.ndarray, shape: Shape) -> tuple[np.ndarray, ...]:
    start = records.start[which]
    return records.doc[which], records.tie[which], start, start + records.extra[which] + shape.length


def _span_batch(arrays: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(a, pa.int64()) for a in arrays], names=["doc", "tie", "start", "end"])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``(id, n_bytes, spans, kept)``: for each row its size, the merged removed spans, and the bytes that stay."""
    spans = repeated_spans(docs, id_col, text_col, **options)
    listed = spans.groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    rows = prepared(docs, id_col, text_col).join(listed, ["doc", "tie"], "left").select("id", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("spans", SPANS), ("kept", pa.binary())])
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts, found, kept = text_bytes(part.column("text")), [], []
                lists = part.column("spans")
                for i, text in enumerate(texts):
                    starts, ends = _merged(lists[i])
                    edges = np.concatenate(([0], np.stack((starts, ends), axis=1).ravel(), [len(text)])).reshape(-1, 2)
                    kept.append(b"".join(text[a:b] for a, b in edges.tolist()))
                    found.append([{"start": a, "end": b} for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
                columns = [part.column("id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(found, SPANS), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return arrow_map(rows, cut, "id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _merged(spans: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
    if not spans.is_valid or not len(spans.values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start, end = (spans.values.field(f).to_numpy() for f in ("start", "end"))
    none = np.zeros(len(start), np.int64)
    return merge_spans(none, none, start, end)[2:]
