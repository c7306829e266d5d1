"""Token ids as Arrow streams of equal-length sequences.

``write_tokens`` range partitions documents by id; each range tokenizes its documents in order,
appends the end id to each, and writes two Arrow stream files into a folder that all executors share:

- ``<name>.arrow``: record batches of ``ids: fixed_size_list<uint16>[length]`` (uint32 for
  vocabularies beyond 65,536 ids) and ``mask: fixed_size_list<bool>[length]``. Documents run on from one sequence into the next; the last
  sequence of a file is padded and its mask is false there.
- ``<name>.docs.arrow``: ``doc_id`` and ``n_tokens`` of each document, in file order.

All batches of a file but the last have the same number of sequences, so ``SequenceFile`` reaches
any sequence by its number as a view of the memory-mapped file, without copying.

A task may run twice (an executor is lost, or is slow and has a twin). Each attempt writes files of
its own, and the manifest, itself written by Spark's committer, names those of the attempt that
counted; others are never read.

Defined results
- A null or empty text has the end id alone. Repeated ids are neighbours, ordered by text; null ids come first.
- An empty table gives an empty manifest and an empty result. Other columns are not read.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spectral_topics.functions.storage import materialize
from spectral_topics.llm.common import arrow_map, file_bytes, filesystem, id_and_text, new_folder, shuffles_deleted, text_bytes, worker_memory
from spectral_topics.llm.token_counts import printable_bytes

#: Ids in a sequence, sequences in a record batch.
LENGTH = 2048
BATCH = 64
PAD = 0
#: Distinct words, and pre-tokens, whose ids a worker remembers.
WORDS = 500_000
PIECES = 400_000
#: Words whose ids are gathered at once.
GATHERED = 500_000

# How the covered kind of vocabulary file normalizes and cuts texts (public; also given with the files).
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {
            "type": "Split",
            "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
            "behavior": "Removed",
            "invert": True,
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}

MANIFEST = "shard int, path string, n_docs long, n_tokens long"


class WordEncoder:
    """Ids of a text from remembered ids of its words.

    The tokenizer's own rules never join what white space separates, so a text's ids are those of
    its words, one after the other. Only ASCII white space is used to separate: it is white space
    for every tokenizer of this kind. Words of Latin-1 characters are lower-cased and cut into
    pre-tokens here, all new ones at once, and the library's model merges each new pre-token. Other
    words, and those that hold a special token, go through the whole library.
    """

    def __init__(self, vocabulary: bytes) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary.decode())
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        spec = json.loads(vocabulary)
        self.type = id_type(spec)
        self.code = "H" if self.type == "<u2" else "I"
        self.merge = self.tokenizer.model.tokenize
        self.pattern = regex.compile(PRE_TOKENIZER["pretokenizers"][0]["pattern"]["Regex"])
        special = "".join("|" + re.escape(t["content"]) for t in spec["added_tokens"])
        # Beyond Latin-1, its further white space, the character that marks ends below, or a special token.
        self.odd = re.compile(r"[^\x01-\x84\x86-\x9f\xa1-\xff]" + special)
        self.written = {b: c for c, b in printable_bytes().items()}
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian ids of each text, of ``self.type``."""
        words = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).view(pa.large_string()))
        coded = words.flatten().dictionary_encode()
        # By numpy: to_pylist makes a scalar of Arrow's for each word on the way.
        distinct = coded.dictionary.view(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        new = [w for w in distinct if w not in self.words]
        if len(self.words) + len(new) > WORDS:
            self.words = newer_half(self.words)
            new = [w for w in distinct if w not in self.words]
        self._learn(new)
        found = [self.words[w] for w in distinct]
        table = np.frombuffer(b"".join(found), self.type)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // table.itemsize
        places, index = np.cumsum(sizes) - sizes, coded.indices.to_numpy()
        parts, ends = [table[:0]], [np.zeros(1, np.int64)]
        for at in range(0, len(index), GATHERED):
            part = index[at : at + GATHERED]
            end = np.cumsum(sizes[part])
            take = np.repeat(places[part] - end + sizes[part], sizes[part]) + np.arange(end[-1])
            parts.append(table[take])
            ends.append(end + ends[-1][-1])
        ids = np.concatenate(parts)
        cuts = np.concatenate(ends)[words.offsets.to_numpy() - words.offsets[0].as_py()].tolist()
        return [ids[s:e].tobytes() for s, e in zip(cuts, cuts[1:])]

    def _learn(self, new: list[bytes]) -> None:
        if b"" in new:
            # Between white space and the edge of a text.
            self.words[b""] = b""
            new = [w for w in new if w]
        if not new:
            return
        text = b"\n".join(new).decode("utf-8", "replace")
        if self.odd.search(text):
            plain, others = [], []
            for word, written in zip(new, text.split("\n"), strict=True):
                (others if self.odd.search(written) else plain).append(word)
            found = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in others], add_special_tokens=False)
            self.words.update((w, array(self.code, e.ids).tobytes()) for w, e in zip(others, found, strict=True))
            if not plain:
                return
            new, text = plain, b"\n".join(plain).decode()
        if len(self.pieces) > PIECES:
            self.pieces = newer_half(self.pieces)
        known, words = self.pieces, self.words
        marked = self.pattern.sub("\\g<0>\0", text.lower()).split("\n")
        for word, line in zip(new, marked, strict=True):
            parts = line.split("\0")
            parts.pop()
            words[word] = b"".join([known[p] if p in known else self._piece(p) for p in parts])

    def _piece(self, piece: str) -> bytes:
        written = piece if piece.isascii() and piece.isprintable() else "".join(map(self.written.__getitem__, piece.encode()))
        self.pieces[piece] = ids = array(self.code, [t.id for t in self.merge(written)]).tobytes()
        return ids


def newer_half(known: dict) -> dict:
    """A full memory without the half that came in first; what of it is in use comes in again."""
    return dict(islice(known.items(), len(known) // 2, None))


def id_type(spec: dict) -> str:
    """The smallest unsigned type that holds every id of a vocabulary."""
    largest = max(chain(spec["model"]["vocab"].values(), (t["id"] for t in spec["added_tokens"])))
    return "<u2" if largest < 1 << 16 else "<u4"


def splits_at_white_space(vocabulary: bytes) -> bool:
    """Whether a tokenizer file is of the kind that ``WordEncoder`` is right for: every setting is compared."""
    spec = json.loads(vocabulary)
    model = spec["model"]
    plain = all(
        not set(t["content"]) & set(" \t\n\r\x0b\x0c") and not t["lstrip"] and not t["rstrip"] and not t["single_word"] and not t["normalized"]
        for t in spec["added_tokens"]
    )
    merges = model.get("type") == "BPE" and not any(
        model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")
    )
    cut = spec.get("normalizer") == NORMALIZER and spec.get("pre_tokenizer") == PRE_TOKENIZER
    return bool(cut and plain and merges and not spec.get("post_processor"))


class TextEncoder:
    """Ids of a text from the library, for tokenizers that ``WordEncoder`` does not cover."""

    def __init__(self, vocabulary: bytes) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary.decode())
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.type = id_type(json.loads(vocabulary))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [np.array(e.ids, self.type).tobytes() for e in found]


def encoder(vocabulary: bytes):
    """The worker's encoder for this vocabulary; its memory of words lasts over tasks."""
    kind = WordEncoder if splits_at_white_space(vocabulary) else TextEncoder
    return worker_memory(("ids", zlib.crc32(vocabulary)), lambda: kind(vocabulary))


class StreamWriter:
    """Writes one shard's stream of ids, a batch of sequences at a time."""

    def __init__(self, path: str, length: int, batch: int, kind: str) -> None:
        self.length, self.batch, self.kind = length, batch, np.dtype(kind)
        ids = pa.uint16() if self.kind.itemsize == 2 else pa.uint32()
        self.schema = pa.schema([("ids", pa.list_(ids, length)), ("mask", pa.list_(pa.bool_(), length))])
        fs, place = filesystem(path)
        fs.create_dir(place.rpartition("/")[0], recursive=True)
        self.sink = fs.open_output_stream(place)
        self.writer = pa.ipc.new_stream(self.sink, self.schema)
        self.held: list[np.ndarray] = []
        self.count = 0

    def add(self, ids: bytes) -> None:
        self.held.append(np.frombuffer(ids, self.kind))
        self.count += len(self.held[-1])
        if self.count >= self.length * self.batch:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        stream = np.concatenate(self.held) if self.held else np.zeros(0, self.kind)
        whole = self.length * self.batch
        at = 0
        while len(stream) - at >= whole:
            self._write(stream[at : at + whole], whole)
            at += whole
        stream = stream[at:]
        if last and len(stream):
            real = len(stream)
            padded = np.full(-(-real // self.length) * self.length, PAD, self.kind)
            padded[:real] = stream
            self._write(padded, real)
            stream = stream[:0]
        self.held, self.count = [stream], len(stream)

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(v), self.length) for v in (ids, mask)]
        self.writer.write_batch(pa.record_batch(lists, schema=self.schema))

    def close(self) -> None:
        self._flush(last=True)
        self.writer.close()
        self.sink.close()


class SequenceFile:
    """Random access to the sequences of a stream file by number."""

    def __init__(self, path: str) -> None:
        fs, place = filesystem(path)
        self.source = pa.memory_map(place) if fs.type_name == "local" else fs.open_input_file(place)
        batches = list(pa.ipc.open_stream(self.source))
        self.ids = [_flat(b.column("ids")) for b in batches]
        self.masks = [b.column("mask") for b in batches]
        self.length = batches[0].schema.field("ids").type.list_size if batches else 0
        self.per_batch = batches[0].num_rows if batches else 1

    def __len__(self) -> int:
        return sum(len(x) for x in self.ids) // self.length if self.length else 0

    def ids_of(self, i: int) -> np.ndarray:
        """The ids of sequence ``i``: a view of the mapped file."""
        b, row = divmod(i, self.per_batch)
        return self.ids[b][row * self.length : (row + 1) * self.length]

    def mask_of(self, i: int) -> np.ndarray:
        b, row = divmod(i, self.per_batch)
        values = self.masks[b].values.slice(row * self.length, self.length)
        return values.to_numpy(zero_copy_only=False)

    def stream(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from the file's ``start``-th; a view where they lie in one batch."""
        size = self.per_batch * self.length
        parts = []
        while n > 0:
            b, at = divmod(start, size)
            part = self.ids[b][at : at + n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint16)


def _flat(lists: pa.FixedSizeListArray) -> np.ndarray:
    return lists.values.to_numpy(zero_copy_only=True)


def write_tokens(
    docs: DataFrame,
    folder: str,
    vocabulary: bytes,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    batch: int = BATCH,
) -> DataFrame:
    """Write the files into ``folder``; the stored manifest ``(shard, path, n_docs, n_tokens)``, shards in id order.

    ``vocabulary`` is a tokenizer file's content (a few MB whatever the input).
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        name = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}"
        out, tokens = None, 0
        tokenizer = encoder(shared.value)
        end = np.array([end_id], tokenizer.type).tobytes()
        index = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])
        docs_sink = docs_writer = None
        n_docs = 0
        for rows in batches:
            if not rows.num_rows:
                continue
            if out is None:
                out = StreamWriter(f"{name}.arrow", length, batch, tokenizer.type)
                fs, place = filesystem(f"{name}.docs.arrow")
                docs_sink = fs.open_output_stream(place)
                docs_writer = pa.ipc.new_stream(docs_sink, index)
            counts = []
            texts = text_bytes(rows.column("text"))
            for at in range(0, len(texts), 256):
                for ids in tokenizer.encode(texts[at : at + 256]):
                    out.add(ids + end)
                    counts.append(len(ids) // len(end) + 1)
            docs_writer.write_batch(pa.record_batch([rows.column("id"), pa.array(counts, pa.int64())], schema=index))
            tokens += sum(counts)
            n_docs += rows.num_rows
        if out is not None:
            out.close()
            docs_writer.close()
            docs_sink.close()
            columns = [pa.array([shard], pa.int32()), pa.array([name]), pa.array([n_docs]), pa.array([tokens])]
            yield pa.record_batch(columns, names=["shard", "path", "n_docs", "n_tokens"])

    ordered = id_and_text(docs, id_col, text_col).repartitionByRange("id").sortWithinPartitions("id", "text")
    with shuffles_deleted(docs.sparkSession):
        return materialize(arrow_map(ordered, write, MANIFEST), "token-manifest")


def shard_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with ``first``, the ids of all shards before each; one row per written file."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_documents(manifest: DataFrame) -> DataFrame:
    """``(id, start, n_tokens, ids_crc32)`` of every document, read from the written files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for path, first in zip(rows.column("path").to_pylist(), rows.column("first").to_pylist(), strict=True):
                sequences = SequenceFile(f"{path}.arrow")
                fs, place = filesystem(f"{path}.docs.arrow")
                at = 0
                with fs.open_input_stream(place) as source:
                    for part in pa.ipc.open_stream(source):
                        starts, crcs = [], []
                        for n in part.column("n_tokens").to_pylist():
                            starts.append(first + at)
                            crcs.append(zlib.crc32(sequences.stream(at, n).astype("<u4")))
                            at += n
                        columns = [part.column("doc_id"), pa.array(starts, pa.int64()), part.column("n_tokens"), pa.array(crcs, pa.int64())]
                        yield pa.record_batch(columns, names=["id", "start", "n_tokens", "ids_crc32"])

    # A file per task, as far as there are enough files.
    shards = shard_starts(manifest)
    dealt = shards.repartition(max(1, manifest.count()), "shard")
    return arrow_map(dealt, read, "id long, start long, n_tokens long, ids_crc32 long")


def token_output(
    docs: DataFrame, vocabulary_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None
) -> DataFrame:
    """Write all documents and describe them as read back from the files."""
    spark: SparkSession = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    return read_documents(write_tokens(docs, folder, file_bytes(vocabulary_path), end_id, id_col, text_col))
