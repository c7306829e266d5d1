"""Each operator gives the same rows, columns and errors on both sides of a switch that only data size turns."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from spectral_topics.operators import corpus, moments, recover
from spectral_topics.operators import tensor as T
from spectral_topics.plans.model import fit


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def tokens(spark):
    data = [(1, 0, 1.0, "x"), (1, 0, 1.0, "x"), (1, 2, 3.0, "y"), (2, 1, 4.0, None), (3, 2, 1.0, "z")] + [(4, i % 3, 1.0, "h") for i in range(40)]
    return spark.createDataFrame(data, "doc_id long, word_id long, cnt double, tag string")


@pytest.fixture
def model(spark):
    return spark.createDataFrame([(i, float(i), -1.0 - i) for i in range(3)], "word_id long, o0 double, o1 double")


def with_threshold(spark, value, action):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", value)
    try:
        return action()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("blocked", [False, True])
def test_lookup_model_keeps_rows_and_columns(spark, tokens, model, blocked):
    given = corpus.block_tokens(tokens) if blocked else tokens
    found = []
    for limit in ("10m", "-1"):
        found.append(with_threshold(spark, limit, lambda: (lambda df: (df.columns, rows(df)))(moments.lookup_model(given, model))))
    assert found[0] == found[1]
    assert found[0][0] == [*given.columns, "o0", "o1"]


@pytest.mark.parametrize("word", [None, 9])
def test_lookup_model_refuses_unknown_words(spark, tokens, model, word):
    bad = tokens.union(spark.createDataFrame([(9, word, 1.0, "b")], tokens.schema))
    for limit in ("10m", "-1"):
        with pytest.raises(PySparkException, match="no row in the model"):
            with_threshold(spark, limit, lambda: moments.lookup_model(bad, model).collect())


def test_hot_documents_change_no_row(tokens):
    cold, hot = corpus.block_tokens(tokens), corpus.block_tokens(tokens, min_hot_rows=10)
    assert "spread" in hot.columns and "spread" not in cold.columns
    for operator in (lambda t: corpus.filter_min_len(t, 3), corpus.term_frequency):
        assert rows(operator(cold)) == rows(operator(hot))


def test_null_ids_fail_everywhere(spark, tokens):
    for bad in ((None, 1, 1.0, ""), (1, None, 1.0, "")):
        given = tokens.union(spark.createDataFrame([bad], tokens.schema))
        for limit in (None, 10):
            with pytest.raises(PySparkException, match="without a document or word id"):
                corpus.block_tokens(given, min_hot_rows=limit).collect()


def test_blocks_follow_the_input(spark, tokens):
    few, many = (corpus.block_count(corpus.block_tokens(tokens, block_rows=n)) for n in (1000, 5))
    assert few == int(spark.conf.get("spark.sql.shuffle.partitions")) and many == 9
    assert "spread" in corpus.block_tokens(tokens, block_rows=5, min_hot_rows=0).columns


CELLS = [(0, 0, 0, 1.0), (1, 1, 1, 2.0), (3, 0, 1, 3.0), (0, 1, 0, 0.5), (3, 1, 1, -1.0)]


def als(spark, cells, local, shape=None):
    df = spark.createDataFrame(cells, "i int, j int, l int, val double")
    found = T.cp_als(df, 2, max_iter=3, shape=shape, local_cells=10_000 if local else 0)
    return [{r["idx"]: (r["f0"], r["f1"]) for r in f.collect()} for f in (found.a, found.b, found.c)]


def test_cp_als_arrays_and_tables(spark):
    """Index 2 of the first mode has no cell: a zero row either way."""
    local, tables = als(spark, CELLS, True, (4, 2, 2)), als(spark, CELLS, False, (4, 2, 2))
    for a, b in zip(local, tables):
        assert sorted(a) == sorted(b)
        for i in a:
            np.testing.assert_allclose(a[i], b[i], atol=1e-9)
    assert local[0][2] == (0.0, 0.0)


@pytest.mark.parametrize("cell", [(0, 5, 0, 1.0), (-1, 0, 0, 1.0), (None, 0, 0, 1.0)])
def test_cells_outside_the_shape(spark, cell):
    for local in (True, False):
        with pytest.raises(ValueError, match="do not fit"):
            als(spark, [*CELLS, cell], local, (4, 2, 2))


@pytest.mark.parametrize("j", [5, -1])
def test_mttkrp_refuses_cells_without_a_factor_row(spark, j):
    df = spark.createDataFrame([(0, 0, 0, 1.0), (0, j, 0, 1.0)], "i int, j int, l int, val double")
    ones = np.ones((2, 1))
    frames = [spark.createDataFrame([(0, 1.0), (1, 1.0)], "idx int, f0 double")] * 3
    with pytest.raises(PySparkException, match="no factor row"):
        T.mttkrp_arrays(df, [None, ones, ones], 0, 2)
    for limit in ("10m", "-1"):
        with pytest.raises(PySparkException, match="no factor row"):
            with_threshold(spark, limit, lambda: T.mttkrp(df, frames, 0).collect())


def test_dependent_columns_fail_both_ways(spark):
    same = spark.createDataFrame([(0, 1.0, 1.0), (1, 1.0, 1.0)], "idx int, f0 double, f1 double")
    with pytest.raises(ValueError, match="linearly dependent"):
        T.LocalFactor(spark, np.ones((2, 2))).orthonormal()
    with pytest.raises(ValueError, match="linearly dependent"):
        T.TableFactor(same, 2).orthonormal()


def test_sign_vote_without_some_rows(spark):
    a = spark.createDataFrame([(1, 1.0)], "idx int, f0 double")
    b = spark.createDataFrame([(0, 1.0), (1, 2.0)], "idx int, f0 double")
    assert rows(T.sign_vote(a, b, b)) == [(0, 0.0), (1, 1.0)]


def test_a_bound_on_the_loop_is_told(spark):
    df = spark.createDataFrame(CELLS, "i int, j int, l int, val double")
    with pytest.warns(UserWarning, match="without convergence"):
        assert not T.cp_als(df, 2, hard_cap=1).converged


def test_repeated_documents_fail(spark):
    tokens = spark.createDataFrame([(1, 0, 2.0), (1, 1, 3.0)], "doc_id long, word_id long, cnt double")
    for docs in ([(1,), (1,)], [(1,), (None,)]):
        with pytest.raises(ValueError, match="ids that differ"):
            fit(spark.createDataFrame(docs, "doc_id long"), tokens, 1, 1, 1.0)


def test_matrices_of_unequal_width_fail(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0])], "row_id long, vec array<double>")
    other = spark.createDataFrame([(1, [1.0])], "row_id long, vec array<double>")
    with pytest.raises(ValueError, match="cannot be added"):
        moments.sum_matrices(one, other)
    assert rows(moments.sum_matrices(one, one)) == [(1, [2.0, 4.0])]


def test_thresholds_never_shuffle_the_data(spark):
    values = spark.range(0, 2000, 1, 8).select((F.col("id") % 5).alias("g"), "id", F.rand(3).alias("v"))

    def plan():
        found = recover.simplex_projection(values, "g", "id", "v")
        found.collect()
        return found._jdf.queryExecution().executedPlan().toString()

    assert "Exchange hashpartitioning" not in with_threshold(spark, "-1", plan).split("== Initial Plan ==")[0]


def test_many_groups_with_a_hot_one(spark, monkeypatch):
    monkeypatch.setattr(recover, "LOCAL_GROUPS", 3)
    values = spark.range(400).select(F.when(F.col("id") < 300, 0).otherwise(F.col("id")).alias("g"), "id", (F.col("id") / 1000).alias("v"))
    sums = recover.simplex_projection(values, "g", "id", "v").groupBy("g").agg(F.sum("v").alias("s"))
    assert all(abs(r["s"] - 1) < 1e-9 for r in sums.collect())
