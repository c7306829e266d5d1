"""Encoding by chunks against the library, for the given model and altered ones, and decoding."""

import hashlib
import random

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

from spectral_topics.llm import sentence_pieces
from spectral_topics.llm.common import file_bytes
from spectral_topics.llm.queries import QUERIES
from tests.llm.conftest import DOCUMENTS

PATH = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = [*"ab  ▁\n\té漢字12.,'  ​\x00ﬁ😀", "the ", "  ", "▁▁", " world", "ing", "   x"]


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=PATH)


def altered(change) -> bytes:
    spec = sentencepiece_model_pb2.ModelProto.FromString(file_bytes(PATH))
    change(spec)
    return spec.SerializeToString()


def no_prefix(spec):
    spec.normalizer_spec.add_dummy_prefix = False


def squeezed(spec):
    spec.normalizer_spec.remove_extra_whitespaces = True


def crossing(spec):
    spec.pieces[31_000].piece = "a▁b"
    spec.pieces[31_000].score = 0


def own_symbol(spec):
    spec.pieces[31_000].piece = "b a"
    spec.pieces[31_000].type = sentencepiece_model_pb2.ModelProto.SentencePiece.USER_DEFINED


@pytest.mark.parametrize("change, independent", [(None, True), (no_prefix, True), (squeezed, False), (crossing, False), (own_symbol, False)])
def test_chunks_give_the_librarys_ids(change, independent):
    model = altered(change) if change else file_bytes(PATH)
    assert sentence_pieces.chunks_are_independent(model) == independent
    chunker = sentence_pieces.Chunker(model)
    rng = random.Random(7)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randrange(40))) for _ in range(4000)] + ["", " ", "  ", "a ", " a", "▁", "▁ ▁"]
    expected = [sentence_pieces.packed(ids) for ids in SentencePieceProcessor(model_proto=model).encode(texts)]
    assert chunker.encode(texts) == expected
    assert chunker.encode(texts[::-1]) == expected[::-1]


def test_little_memory_gives_the_same(library, monkeypatch):
    monkeypatch.setattr(sentence_pieces, "REMEMBERED", 3)
    monkeypatch.setattr(sentence_pieces, "LONGEST", 4)
    chunker = sentence_pieces.Chunker(file_bytes(PATH))
    for text in ["one two three four five one two", "two two six seven", "one eight", ""]:
        assert chunker.encode([text]) == [sentence_pieces.packed(library.encode(text))]
        assert len(chunker.known) <= 5 and max(map(len, chunker.known)) <= 4


def test_operator_on_messy_documents(docs, no_docs, library):
    encoded = sentence_pieces.encode(docs, PATH)
    found = sentence_pieces.decode(encoded, PATH).collect()
    texts = [(i, t or "") for i, t, _, _ in DOCUMENTS]
    assert sorted(((r["id"], r["ids"], r["decoded"]) for r in found), key=str) == sorted(
        ((i, library.encode(t), library.decode(library.encode(t))) for i, t in texts), key=str
    )
    assert sentence_pieces.decode(sentence_pieces.encode(no_docs, PATH), PATH).collect() == []
    with pytest.raises(ValueError):
        sentence_pieces.decode(docs, PATH, "doc_id", "digest")


def test_decode_keeps_columns_and_takes_nulls(spark, library):
    ids = library.encode("some words and 漢字")
    rows = spark.createDataFrame([(1, ids, "x"), (2, None, None), (3, [], "z")], "n int, ids array<int>, other string")
    found = sentence_pieces.decode(rows, PATH, text_col="text").orderBy("n").collect()
    assert [tuple(r) for r in found] == [(1, ids, "x", "some words and 漢字"), (2, None, None, ""), (3, [], "z", "")]


def test_query_on_a_whole_table(spark, library):
    sf = "/root/testdata/sf0.001"
    found = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op13_sentence_pieces"](spark, sf).collect()}
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(texts)
    for doc, text in texts:
        ids = library.encode(text or "")
        digests = [hashlib.sha256(s.encode()).hexdigest() for s in (",".join(map(str, ids)), library.decode(ids))]
        assert found[doc] == (len(ids), *digests)
