import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from spectral_topics.operators import corpus

MINI = [(1, 0, 2.0), (1, 1, 1.0), (2, 1, 2.0), (2, 2, 2.0), (3, 0, 1.0), (5, 0, 1.0), (5, 2, 1.0)]


@pytest.fixture
def mini(spark):
    docs = spark.createDataFrame([(i,) for i in range(1, 6)], "doc_id long")
    return docs, spark.createDataFrame(MINI, "doc_id long, word_id long, cnt double")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_doc_terms_merges_repeats(spark):
    repeated = spark.createDataFrame([(1, 3, 1.0), (1, 3, 4.0), (1, 2, 0.5)], "doc_id long, word_id long, cnt double")
    assert rows(corpus.doc_terms(repeated)) == [(1, 2, 0.5), (1, 3, 5.0)]


def test_flatten_documents(spark):
    nested = spark.createDataFrame(
        [(1, [(3, 1.0), (3, 4.0)]), (2, [])], "doc_id long, tokens array<struct<word_id:long,cnt:double>>"
    )
    assert rows(corpus.flatten_documents(nested)) == [(1, 3, 5.0)]


def test_doc_stats_keeps_empty_documents(mini):
    docs, tokens = mini
    stats = corpus.doc_stats(docs, tokens)
    assert rows(stats) == [(1, 3.0), (2, 4.0), (3, 1.0), (4, 0.0), (5, 2.0)]
    assert tuple(corpus.corpus_counts(stats).first()) == (5, 3, 2)


def test_weights_are_null_for_short_documents(mini):
    docs, tokens = mini
    found = {r[0]: tuple(r[2:]) for r in corpus.moment_weights(corpus.doc_stats(docs, tokens), 1.0).collect()}
    assert found[1] == pytest.approx((1 / 6, 2 / 12, 6 / 12))
    assert found[5] == (0.5, None, None)
    assert found[3] == found[4] == (None, None, None)


def test_min_length_and_frequency(mini):
    _, tokens = mini
    assert {r[0] for r in corpus.filter_min_len(tokens, 3).collect()} == {1, 2}
    frequencies = corpus.term_frequency(tokens).groupBy("doc_id").agg(F.sum("tf"))
    assert all(v == pytest.approx(1.0) for _, v in frequencies.collect())


def test_word_id_outside_vocabulary_raises(mini):
    _, tokens = mini
    assert corpus.check_word_ids(tokens, 3).count() == len(MINI)
    with pytest.raises(PySparkException, match="outside 0..1"):
        corpus.check_word_ids(tokens, 2).count()


@pytest.fixture
def lopsided(spark):
    """One document holds two thirds of the tokens; copies of one word make up half of those."""
    big = [(7, w % 50, 1.0) for w in range(200)] + [(7, 3, 1.0)] * 200
    small = [(d, (d * 7 + w) % 50, 1.0 + w) for d in range(100, 140) for w in range(5)]
    return spark.createDataFrame(big + small, "doc_id long, word_id long, cnt double")


def test_large_document_is_spread(spark, lopsided):
    blocked = corpus.block_tokens(lopsided, partitions=8, min_hot_rows=100)
    assert "spread" in blocked.columns and corpus.block_count(blocked) == 8
    per_block = {r[0]: r[1] for r in blocked.where("doc_id = 7").groupBy("block").count().collect()}
    assert len(per_block) == 8
    assert blocked.groupBy("doc_id").agg(F.countDistinct("block").alias("n")).where("n > 1").count() == 1
    assert blocked.rdd.getNumPartitions() == 8


def test_spread_documents_give_the_same_sums(spark, lopsided):
    plain = corpus.block_tokens(lopsided)
    spread = corpus.block_tokens(lopsided, min_hot_rows=100)
    assert "spread" not in plain.columns
    sums = {"len": F.sum("cnt")}
    assert rows(corpus.document_sums(spread, sums)) == rows(corpus.document_sums(plain, sums))
    merged = [corpus.doc_terms(corpus.join_document_sums(t, sums).select("doc_id", "word_id", "cnt")) for t in (plain, spread)]
    assert rows(merged[0]) == rows(merged[1])
    joined = [corpus.join_document_sums(t, sums).select("doc_id", "len").distinct() for t in (plain, spread)]
    assert rows(joined[0]) == rows(joined[1])


def test_no_shuffle_between_blocked_tokens_and_their_documents(spark, lopsided, no_broadcast):
    blocked = corpus.block_tokens(lopsided).sortWithinPartitions("block", "doc_id").persist()
    blocked.count()
    joined = corpus.join_document_sums(blocked, {"len": F.sum("cnt")})
    plan = joined._jdf.queryExecution().executedPlan().toString()
    above_cache = [line for line in plan.split("\n") if "Exchange" in line and "shufflepartitionid" not in line]
    assert not above_cache, plan
    blocked.unpersist()
