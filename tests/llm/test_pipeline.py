"""The pipeline's stages and the registered queries over small tables, against brute force."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from spectral_topics.functions.storage import materialize
from spectral_topics.llm import toxicity
from spectral_topics.llm.queries import ORACLES, QUERIES, tokenizer
from tests.llm.test_operators import hits_by_hand, kept_by_hand, targets_by_hand, words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What goes into each stage and what comes out."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = {"documents": docs.toPandas()}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), f"test-{name}")
        found[name] = docs.toPandas()
    return found


def test_columns(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash_near_dedup", "decontamination", "mixing", "token_output"]
    for name in names[:-1]:
        assert list(stages[name].columns) == list(stages["documents"].columns)


def test_toxic_documents_go(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = toxicity.score_toxicity(docs, model).toPandas()
    assert set(stages["toxicity"].doc_id) == set(scores.id[scores.score < 0.7])


def test_one_of_each_group_stays(stages):
    """Groups of five-word shingle sets of Jaccard similarity 0.8 or more, all pairs compared."""
    before = stages["toxicity"].sort_values("doc_id")
    ids, texts = before.doc_id.tolist(), before.text.fillna("").tolist()
    assert sorted(stages["simhash_near_dedup"].doc_id) == [ids[i] for i in kept_by_hand(texts)]


def test_passages_are_cut(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    before, after = stages["simhash_near_dedup"], dict(zip(stages["decontamination"].doc_id, stages["decontamination"].text))
    for doc, text, (n, hit, _) in zip(before.doc_id, before.text, hits_by_hand(before.text, items)):
        if not hit:
            assert after[doc] == text
        elif hit == n:
            assert doc not in after
        else:
            assert len(words(after[doc])) == n - hit


def test_sources_come_near_their_targets(stages):
    before, after = stages["decontamination"], stages["mixing"]
    copies = Counter(after.doc_id)
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for d, t in zip(before.doc_id, before.text)}
    total = before.assign(size=before.doc_id.map(size)).groupby("source")["size"].sum().to_dict()
    target = targets_by_hand(total, (5, 2, 1), 3)
    for source, group in before.groupby("source"):
        rate = target[source] / total[source]
        for doc in group.doc_id:
            assert int(rate - 1e-6) <= copies[doc] <= int(rate + 1e-6) + 1
        assert abs(sum(copies[d] for d in group.doc_id) - rate * len(group)) <= 1 + 1e-6


def test_token_files(stages):
    docs, found = stages["mixing"].sort_values(["doc_id", "text"]), stages["token_output"].sort_values("start")
    ids = [e.ids + [2] for e in Tokenizer.from_file(tokenizer("word_bpe_49k.json")).encode_batch(docs.text.tolist(), add_special_tokens=False)]
    assert found.doc_id.tolist() == docs.doc_id.tolist()
    assert found.n_tokens.tolist() == [len(x) for x in ids]
    assert found.start.tolist() == np.cumsum([0, *map(len, ids)])[:-1].tolist()
    assert found.ids_crc32.tolist() == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]


def test_every_operator_is_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
    assert corpus_pipeline.ORACLE_SQL is None and set(corpus_pipeline.QUERIES) == {"pipeline"}
