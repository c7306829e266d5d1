import numpy as np
import pytest
from brute import admm, matrix, simplex
from pyspark.sql import functions as F

from spectral_topics.operators import recover


def grouped(spark, groups):
    rows = [(g, i, float(v)) for g, values in enumerate(groups) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "topic int, word_id long, value double").repartition(3)


def by_group(df, sizes, value="value"):
    out = [np.full(n, np.nan) for n in sizes]
    for g, i, v in df.select("topic", "word_id", value).collect():
        out[g][i] = v
    return out


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(12)
    return [
        np.array([0.5, 0.4, 0.2, -0.1]),
        rng.normal(size=300),
        rng.exponential(size=200) / 10,
        np.full(50, 0.02),
        np.array([-7.0]),
        np.r_[np.zeros(150), 0.3, 0.3, 0.9],
        2.0 ** -np.arange(60),
        rng.normal(size=80) * 1e-6,
        rng.normal(size=80) * 1e4,
    ]


@pytest.mark.parametrize("local_groups", [recover.LOCAL_GROUPS, 3])
def test_simplex_projection(spark, groups, monkeypatch, local_groups):
    monkeypatch.setattr(recover, "LOCAL_GROUPS", local_groups)
    df = grouped(spark, groups)
    found = by_group(recover.simplex_projection(df, "topic", "word_id", "value"), map(len, groups))
    for values, projected in zip(groups, found):
        np.testing.assert_allclose(projected, simplex(values), atol=1e-9 * max(1, np.abs(values).max()))
    np.testing.assert_allclose(found[0], [7 / 15, 11 / 30, 1 / 6, 0])


def test_projection_is_idempotent(spark, groups):
    df = recover.simplex_projection(grouped(spark, groups[:4]), "topic", "word_id", "value")
    once = by_group(df, map(len, groups[:4]))
    twice = by_group(recover.simplex_projection(df, "topic", "word_id", "value"), map(len, groups[:4]))
    for a, b in zip(once, twice):
        np.testing.assert_allclose(a, b, atol=1e-12)


@pytest.mark.parametrize("rounds", [1, 3, 20])
def test_recovery_equals_admm_rounds(spark, groups, rounds):
    picked = groups[:7]
    found = by_group(recover.recover_topic(grouped(spark, picked), iterations=rounds), map(len, picked))
    for values, z in zip(picked, found):
        np.testing.assert_allclose(z, admm(values, rounds), atol=1e-9)


def test_recovered_topics_pick_the_closer_sign(spark):
    rng = np.random.default_rng(13)
    f = np.column_stack([rng.dirichlet(np.ones(40) * 0.2), -rng.dirichlet(np.ones(40) * 0.2), rng.normal(size=40) / 10])
    columns = ", ".join(f"f{j} double" for j in range(3))
    df = spark.createDataFrame([(w, *map(float, v)) for w, v in enumerate(f)], f"word_id long, {columns}")
    found = matrix(recover.recover_topics(df), "p")
    for t, col in enumerate(f.T):
        plus, minus = admm(col, 20), admm(-col, 20)
        best = plus if np.linalg.norm(plus - col) < np.linalg.norm(minus + col) else minus
        np.testing.assert_allclose(found[:, t], best, atol=1e-10)
    np.testing.assert_allclose(found.sum(axis=0), 1)


def test_dirichlet_prior(spark):
    lambdas = spark.createDataFrame([(0, 1.0), (1, 2.0)], "topic int, lambda double")
    assert {r[0]: r[1] for r in recover.dirichlet_prior(lambdas, 3.0).collect()} == pytest.approx({0: 2.4, 1: 0.6})


def test_unwhiten(spark):
    rng = np.random.default_rng(14)
    model, a, lambdas = rng.normal(size=(30, 3)), rng.normal(size=(3, 3)), np.array([2.0, 1.0, 0.5])
    columns = ", ".join(f"o{j} double" for j in range(3))
    df = spark.createDataFrame([(w, *map(float, v)) for w, v in enumerate(model)], f"word_id long, {columns}")
    expected = model @ np.linalg.inv(model.T @ model) @ a @ np.diag(lambdas)
    np.testing.assert_allclose(matrix(recover.unwhiten(df, a, lambdas), "f"), expected, atol=1e-12)


@pytest.mark.parametrize("k", [5, 1500])
def test_top_k(spark, k):
    df = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, F.col("id") % 7).otherwise(99).alias("topic"),
        F.col("id").alias("word_id"),
        (F.col("id") * 7919 % 1000).cast("double").alias("prob"),
    )
    found = sorted(map(tuple, recover.top_words(df, k).collect()))
    frame = df.toPandas().sort_values(["topic", "prob", "word_id"], ascending=[True, False, True])
    frame["rank"] = frame.groupby("topic").cumcount() + 1
    expected = frame[frame["rank"] <= k]
    assert found == sorted(map(tuple, expected[["topic", "rank", "word_id", "prob"]].itertuples(index=False)))


def test_running_sum_of_a_large_group(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 10 == 0, F.col("id") % 30).otherwise(5).alias("g"),
        F.col("id").alias("word_id"),
        (F.col("id") * 31 % 17).alias("v"),
    )
    found = recover.running_sum(df, "g", [F.desc("v"), F.asc("word_id")], "v").toPandas()
    frame = df.toPandas().sort_values(["g", "v", "word_id"], ascending=[True, False, True])
    frame["running"], frame["position"] = frame.groupby("g")["v"].cumsum(), frame.groupby("g").cumcount() + 1
    both = frame.merge(found, on=["g", "word_id"], suffixes=("", "_found"))
    assert len(both) == 3000
    assert (both["running"] == both["running_found"]).all() and (both["position"] == both["position_found"]).all()


@pytest.mark.parametrize("local_groups", [recover.LOCAL_GROUPS, 1])
def test_projection_keeps_null_groups_and_any_names(spark, monkeypatch, local_groups):
    monkeypatch.setattr(recover, "LOCAL_GROUPS", local_groups)
    rows = [(None, "x", i, v) for i, v in enumerate([0.9, 0.4])] + [(1, None, i, v) for i, v in enumerate([2.0, 1.5, 0.1])]
    rows += [(None, None, 0, 5.0), (1, "x", 0, -3.0)]
    df = spark.createDataFrame(rows, "theta int, n string, width int, s double").repartition(3)
    found = recover.simplex_projection(df, ["theta", "n"], "width", "s")
    assert found.columns == ["theta", "n", "width", "s"]
    expected = {(None, "x"): [0.75, 0.25], (1, None): [0.75, 0.25, 0.0], (None, None): [1.0], (1, "x"): [1.0]}
    got = {(r["theta"], r["n"], r["width"]): r["s"] for r in found.collect()}
    assert got == pytest.approx({(*g, i): v for g, values in expected.items() for i, v in enumerate(values)})
    again = recover.recover_topic(df, ["theta", "n"], "width", "s", iterations=None)
    assert {(r["theta"], r["n"], r["width"]): r["s"] for r in again.collect()} == pytest.approx(got)


def test_projection_of_a_null_value_fails(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (0, 1, None)], "topic int, word_id int, value double")
    with pytest.raises(Exception, match="null value"):
        recover.simplex_projection(df, "topic", "word_id", "value").collect()


def test_running_sum_keeps_null_groups_values_and_names(spark):
    names = ["range", "here", "at", "s0", "n0", "its_group"]
    rows = [(g, i, None if i == 2 else float(i), *[7] * 6) for g in (None, "a", "b") for i in range(9)]
    df = spark.createDataFrame(rows, "g string, i int, v double, " + ", ".join(f"{n} int" for n in names)).repartition(4)
    found = recover.running_sum(df, "g", [F.asc("i")], "v", partitions=5).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r["position"] == r["i"] + 1 and r["running"] == sum(j for j in range(r["i"] + 1) if j != 2)
        assert all(r[n] == 7 for n in names)
    with pytest.raises(ValueError):
        recover.running_sum(df.withColumn("running", F.lit(1)), "g", [F.asc("i")], "v")


def test_top_k_keeps_a_column_named_piece(spark, monkeypatch):
    monkeypatch.setattr(recover, "GROUP_LIMIT_ROWS", 2)
    df = spark.createDataFrame([(None if i % 2 else "g", i, 5) for i in range(20)], "g string, v int, piece int")
    found = recover.top_k(df, "g", [F.desc("v")], 3, spread_by="v").collect()
    assert sorted((r["v"], r["piece"], r["rank"]) for r in found) == [(14, 5, 3), (15, 5, 3), (16, 5, 2), (17, 5, 2), (18, 5, 1), (19, 5, 1)]
