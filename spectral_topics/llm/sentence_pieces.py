"""SentencePiece encoding by a table of distinct chunks, and decoding.

SentencePiece writes white space as a marker and merges pieces inside what follows. When no piece of the
vocabulary has a marker behind another character, no piece can cross the place where a marker follows
something else, so a text's pieces are those of its chunks (markers, then characters up to the next marker)
one after the other. The model's settings and pieces are checked for this once (``Chunker``): byte-pair merges, no
character map, no removal of spaces, no user-defined symbols. Other models encode whole texts.

A task takes its rows in slices. The distinct chunks of a slice form a table; the library segments each of them
once, unless a slice shortly before had it, and the ids are joined back by the chunks' positions. What is
remembered between slices is bounded, and chunks that are still in use stay. Tables of the whole corpus would shuffle
each word with its place, several times the input, to save a few thousand library calls a task.

Defined results
- A null text is empty; an empty text has no ids. Ids decode with the library's ``decode``; null ids decode to "".
- The marker character itself in a text counts as a space, as in the library.
- Repeated ids give repeated rows. An empty table gives an empty result. Other columns are not read by ``encode``;
  ``decode`` keeps them.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from spectral_topics.llm.common import arrow_map, file_bytes, id_and_text, slices, text_bytes, worker_memory

MARKER = "▁"
CHUNKS = re.compile(" *[^ ]+| +")
#: Chunks remembered from slice to slice besides those of the slice itself, and the longest that is remembered.
REMEMBERED = 300_000
LONGEST = 64
#: Bytes of text whose chunks make one table.
SLICE_BYTES = 1 << 20


def chunks_are_independent(model: bytes) -> bool:
    """Whether the pieces of a text are those of its chunks, as far as the model's file proves it."""
    from sentencepiece import sentencepiece_model_pb2 as format

    spec = format.ModelProto.FromString(model)
    normal, trained = spec.normalizer_spec, spec.trainer_spec
    plain = not normal.precompiled_charsmap and not normal.remove_extra_whitespaces and normal.escape_whitespaces
    merges = trained.model_type == format.TrainerSpec.BPE and not trained.treat_whitespace_as_suffix
    kinds = format.ModelProto.SentencePiece
    own = any(p.type == kinds.USER_DEFINED for p in spec.pieces)
    crossing = any(p.type in (kinds.NORMAL, kinds.UNUSED) and re.search(f"[^{MARKER}]{MARKER}", p.piece) for p in spec.pieces)
    return plain and merges and not own and not crossing


class Chunker:
    def __init__(self, model: bytes) -> None:
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        self.library = SentencePieceProcessor(model_proto=model)
        self.independent = chunks_are_independent(model)
        self.prefix = sentencepiece_model_pb2.ModelProto.FromString(model).normalizer_spec.add_dummy_prefix
        # The library adds no marker to an empty text, so a lone marker is read off behind a letter.
        alone = self.segment(["a "])[0][len(self.segment(["a"])[0]) :]
        self.marker = {"" if self.prefix else " ": packed(alone)}
        self.known = dict(self.marker)

    def segment(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, add_bos=False, add_eos=False, enable_sampling=False, num_threads=1)

    def chunks(self, text: str) -> list[str]:
        """The text's chunks as the library is to be given them: without the marker that it adds itself."""
        if not text:
            return []
        text = text.replace(MARKER, " ")
        if not self.prefix:
            return CHUNKS.findall(text)
        if "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [c[1:] for c in CHUNKS.findall(" " + text)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as 32-bit numbers of the machine."""
        if not self.independent:
            return [packed(ids) for ids in self.segment(texts)]
        parts = [self.chunks(t) for t in texts]
        distinct = set(chain.from_iterable(parts))
        new = list(distinct.difference(self.known))
        self.known.update(zip(new, map(packed, self.segment(new)), strict=True))
        found = [b"".join(map(self.known.__getitem__, p)) for p in parts]
        if len(self.known) > REMEMBERED or any(len(c) > LONGEST for c in new):
            # Chunks of the slice stay, so a full memory doesn't forget what is in use.
            kept = self.known if len(self.known) <= REMEMBERED else distinct
            self.known = self.marker | {c: self.known[c] for c in kept if len(c) <= LONGEST}
        return found


def packed(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


def chunker(model: bytes) -> Chunker:
    return worker_memory(("pieces", zlib.crc32(model), len(model)), lambda: Chunker(model))


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids)`` for each row of ``docs``: the library's ids of the whole text, without begin or end.

    One pass without a shuffle. The model is broadcast; its size doesn't grow with the input.
    """
    shared = docs.sparkSession.sparkContext.broadcast(file_bytes(model_path))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = chunker(shared.value).encode
        for whole in batches:
            for rows in slices(whole, "text", SLICE_BYTES):
                found = encode([t.decode("utf-8", "replace") for t in text_bytes(rows.column("text"))])
                ends = np.cumsum([0, *(len(f) // 4 for f in found)])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), np.int32)))
                yield pa.RecordBatch.from_arrays([rows.column("id"), ids], names=["id", "ids"])

    return arrow_map(id_and_text(docs, id_col, text_col), encoded, "id long, ids array<int>")


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text that the library decodes from ``ids_col``, in ``text_col`` behind all other columns."""
    if text_col in encoded.columns:
        raise ValueError(f"there is a column {text_col} already")
    shared = encoded.sparkSession.sparkContext.broadcast(file_bytes(model_path))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = chunker(shared.value).library
        for rows in batches:
            column = rows.column(ids_col)
            numbers, ends = column.flatten().to_numpy().tolist(), np.cumsum(column.value_lengths().fill_null(0)).tolist()
            texts = [library.decode(numbers[s:e]) if e > s else "" for s, e in zip([0, *ends], ends)]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(texts, pa.string())], names=[*rows.schema.names, text_col])

    return arrow_map(encoded, decoded, StructType([*encoded.schema.fields, StructField(text_col, StringType())]))
