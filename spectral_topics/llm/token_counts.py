"""Token counts with a whole-token shortcut, for byte-level BPE vocabularies.

Once per vocabulary (``whole_tokens``) every vocabulary string is decoded and tried: those that the
library encodes, alone, as exactly their own single id are whole tokens. A pre-token that is one of
them counts 1 without any merging. Only other pre-tokens go through the library's merges, and their
counts are remembered.

A text is cut where a single space stands between two characters that are not white space. The
pre-tokenizer always starts a new pre-token there, whatever stands around, so the parts can be
counted one by one and their counts remembered too. Texts that hold the string of a special token,
or parts with characters on which Unicode versions might differ, go to the library whole.

Defined results
- A null text is empty and has 0 bytes and 0 tokens. Special strings inside a text are matched as
  the library does by default.
- Repeated ids give repeated rows. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from spectral_topics.llm.common import arrow_map, file_bytes, id_and_text, text_bytes, worker_memory

# Fixed value: the pre-token pattern of byte-level BPE vocabularies (public; also given with the vocabulary files).
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Below this code point all Unicode versions in use agree on what is a letter, number or white space.
AGREED = 0x0530
#: A single space between two other characters: a pre-token always begins there.
CUT = re.compile(r"(?<=\S)(?= \S)")
#: White space other than single inner spaces: such texts are cut by CUT, others by splitting.
UNEVEN = re.compile(r"\s |\A |\s\Z")
MEMO = 400_000


def printable_bytes() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: itself where it is visible, else the next from 256 on."""
    visible = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    shifted = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(shifted)}


def whole_tokens(vocabulary: bytes) -> frozenset[str]:
    """Vocabulary strings that the library, given one alone, encodes as its single id."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(vocabulary.decode())
    to_byte = printable_bytes()
    decoded = {}
    for written, number in json.loads(vocabulary)["model"]["vocab"].items():
        try:
            decoded[number] = bytes(to_byte[c] for c in written).decode()
        except (KeyError, UnicodeDecodeError):
            continue  # part of a character, or not of this kind: left to the merges
    numbers = list(decoded)
    found = tokenizer.encode_batch_fast([decoded[n] for n in numbers], add_special_tokens=False)
    return frozenset(decoded[n] for n, e in zip(numbers, found, strict=True) if e.ids == [n])


class TokenCounter:
    def __init__(self, vocabulary: bytes, whole: frozenset[str]) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary.decode())
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        spec = json.loads(vocabulary)
        pre = spec["pre_tokenizer"] or {}
        self.covered = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.whole = whole
        self.known: dict[str, int] = {}
        self.merged: dict[str, int] = {}

    def library(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.covered or (self.special and self.special.search(text)):
            return self.library(text)
        if UNEVEN.search(text):
            parts = CUT.split(text)
        else:
            first, *rest = text.split(" ")
            parts = [first, *[" " + w for w in rest]]
        known = self.known
        total = 0
        for part in parts:
            n = known.get(part)
            if n is None:
                n = self.part(part)
            total += n
        return total

    def part(self, part: str) -> int:
        if part in self.whole:
            n = 1
        elif part.isascii() or ord(max(part)) < AGREED:
            n = 0
            for token in PRE_TOKEN.findall(part):
                n += 1 if token in self.whole else self.merge(token)
        else:
            n = self.library(part)
        if len(self.known) >= MEMO:
            self.known.clear()
        if len(part) < 100:
            self.known[part] = n
        return n

    def merge(self, token: str) -> int:
        n = self.merged.get(token)
        if n is None:
            n = self.library(token)
            if len(self.merged) >= MEMO:
                self.merged.clear()
            if len(token) < 100:
                self.merged[token] = n
        return n


def token_counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, n_tokens)`` for each row of ``docs``, in one pass without a shuffle.

    The vocabulary and its whole tokens are broadcast; their size is the vocabulary's, whatever the input.
    """
    vocabulary = file_bytes(vocabulary_path)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, whole_tokens(vocabulary)))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, whole = shared.value
        count = worker_memory(("counts", zlib.crc32(vocabulary)), lambda: TokenCounter(vocabulary, whole)).count
        for rows in batches:
            texts = text_bytes(rows.column("text"))
            tokens = [count(t.decode("utf-8", "replace")) for t in texts]
            columns = [rows.column("id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(tokens, pa.int64())]
            yield pa.record_batch(columns, names=["id", "n_bytes", "n_tokens"])

    return arrow_map(id_and_text(docs, id_col, text_col), counts, "id long, n_bytes long, n_tokens long")
