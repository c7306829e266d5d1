"""Words of texts as numbered tokens."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from spectral_topics.operators import corpus, moments
from spectral_topics.operators.words import numbered_slices, slices, text_words
from workloads import registry

TEXTS = {1: "The cat and the Cat", 2: None, 3: "", 4: "and and the İdea", 5: "cat", 6: "THE the The dog", 7: "dog dog dog dog dog"}


def words_of(spark, partitions):
    docs = spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").coalesce(partitions)
    return docs.select("doc_id", F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0)).alias("words"))


@pytest.mark.parametrize("size", [1, 4, 100])
def test_slices_give_the_words_of_each_document(spark, size):
    """However texts are cut into slices; spellings of one word add up; texts without words have no tokens."""
    sliced = slices(words_of(spark, 1), size).persist()
    spelled = sliced.where("spellings is not null").select("slice", F.posexplode("spellings").alias("code", "word"))
    # A slice names a spelling once, so frequent words are no hot keys of the join that numbers them.
    assert spelled.groupBy("slice", "word").count().where("count > 1").isEmpty()
    assert sliced.where("spellings is null").count() == len(TEXTS)
    numbers = {w: 10 * i for i, w in enumerate(sorted({w for t in TEXTS.values() for w in lower_words(spark, t)}))}
    given = spark.createDataFrame(list(numbers.items()), "word string, word_id long")
    ids = spelled.withColumn("word", F.lower("word")).join(given, "word")
    ids = ids.select(F.col("slice").alias("slice"), F.col("code").alias("code"), "word_id")
    found = numbered_slices(sliced.where("spellings is null"), ids).collect()
    expected = {(d, numbers[w], float(n)) for d, t in TEXTS.items() for w, n in Counter(lower_words(spark, t)).items()}
    assert len(found) == len(expected) and {tuple(r) for r in found} == expected
    sliced.unpersist()


def lower_words(spark, text):
    row = spark.createDataFrame([(text,)], "text string").select(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0)).alias("w"))
    return [r[0] for r in row.select(F.explode("w").alias("w")).select(F.lower("w")).collect()]


def test_an_empty_table_has_no_slices(spark):
    assert slices(words_of(spark, 1).limit(0)).isEmpty()


def test_blocks_are_summed_without_sorting_or_joining_tokens(spark, no_broadcast):
    """Tokens that are kept in blocks go to numpy with the fetched model rows; before, each pass joined and sorted them twice."""
    rows = [(f"d{d}", w, 1.0 + (d + w) % 3) for d in range(40) for w in range(d % 5, 12, 1 + d % 4)] + [("single", 3, 1.0)]
    tokens = spark.createDataFrame(rows, "doc_id string, word_id long, cnt double")
    model = spark.range(12).select(F.col("id").alias("word_id"), F.sin("id").alias("o0"), F.cos("id").alias("o1"))
    blocks = corpus.block_tokens(tokens).sortWithinPartitions("block", "doc_id").persist()
    routes = moments.word_routes(blocks).persist()
    wide = model.toDF("word_id", "o0", "o1")
    for made in (lambda t, **kw: moments.pair_moment_sketch(t, wide, **kw), lambda t, **kw: moments.word_corrections(t, wide, 1.0, **kw)):
        found = made(blocks, rows=12, routes=routes)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in plan
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
        joined = made(tokens, rows=12)
        assert "FlatMapCoGroupsInArrow" not in joined._jdf.queryExecution().executedPlan().toString()
        expected = {r[0]: r[1:] for r in joined.collect()}
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = {r[0]: r[1:] for r in found.collect()}
        assert got.keys() == expected.keys()
        assert all(tuple(got[w]) == pytest.approx(tuple(expected[w]), abs=1e-12) for w in got)
    routes.unpersist()
    blocks.unpersist()


def test_queries_with_several_passes_keep_their_blocks(spark, no_broadcast, monkeypatch):
    """Before, spectral_factor and third_moment_word_corrected blocked their tokens anew for every reading."""
    seen = []

    def spied(function):
        def call(tokens, *args, **kw):
            seen.append((tokens.storageLevel.useMemory, kw["routes"] is not None))
            return function(tokens, *args, **kw)

        return call

    monkeypatch.setattr(registry.moments, "pair_moment_sketch", spied(registry.moments.pair_moment_sketch))
    monkeypatch.setattr(registry, "project_and_contract", spied(registry.project_and_contract))
    assert not registry.text_sketch(spark, "/root/testdata/sf0.001").isEmpty()
    assert registry.third_moment_word_corrected(spark, "/root/testdata/sf0.001").count() == 8
    assert seen == [(True, True)] * 2


def test_ascii_texts_are_cut_outside_spark(spark):
    """Texts that touch, begin or end with letters, nulls, empty ones, others: the words of Spark's own expression."""
    texts = ["ab cd", "ef", "gh-ij9k", None, "", " ", "\x00Z[a`{z@A", "\u00e9t\u00e9 na\u00efve a", "\u00aa\u00b5 \u4e2d\u6587x", "one", "one two one", "..."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    by_spark = docs.select("doc_id", F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0)).alias("words"))
    found = docs.select("doc_id", *text_words())
    assert [r["doc_id"] for r in found.where("words IS NOT NULL").collect()] == [7, 8]
    for size in (1, 4, 100):
        assert sorted(map(str, slices(found, size).collect())) == sorted(map(str, slices(by_spark, size).collect()))
    assert by_spark.selectExpr("sum(size(words))").first()[0] > 15
