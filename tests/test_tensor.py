import numpy as np
import pytest
from brute import matrix
from pyspark.errors import PySparkException

from spectral_topics.functions import skew
from spectral_topics.operators import fibres
from spectral_topics.operators import tensor as T


def cells(spark, values):
    rows = [(*map(int, at), float(v)) for at, v in np.ndenumerate(values) for at in [at] if v != 0]
    return spark.createDataFrame(rows, "i int, j int, l int, val double").repartition(3)


def factor(spark, values):
    columns = ", ".join(f"f{j} double" for j in range(values.shape[1]))
    return spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(values)], f"idx int, {columns}")


@pytest.fixture(scope="module")
def problem():
    rng = np.random.default_rng(8)
    return rng.normal(size=(4, 5, 6)), [rng.normal(size=(n, 3)) for n in (4, 5, 6)]


EINSUM = ["ijl,jr,lr->ir", "ijl,ir,lr->jr", "ijl,ir,jr->lr"]


def mttkrp(values, factors, mode):
    return np.einsum(EINSUM[mode], values, *[f for m, f in enumerate(factors) if m != mode])


@pytest.mark.parametrize("mode", [0, 1, 2])
def test_mttkrp(spark, problem, mode):
    values, factors = problem
    expected = mttkrp(values, factors, mode)
    table, frames = cells(spark, values), [factor(spark, f) for f in factors]
    np.testing.assert_allclose(matrix(T.mttkrp(table, frames, mode), "f", "idx"), expected, atol=1e-12)
    np.testing.assert_allclose(T.mttkrp_arrays(table, factors, mode, len(expected)), expected, atol=1e-12)


def test_mttkrp_with_long_skewed_modes(spark, problem, no_broadcast, monkeypatch):
    """Shuffle joins with every index counted as hot."""
    monkeypatch.setattr(skew, "MIN_HOT_ROWS", 3)
    values, factors = problem
    table, frames = cells(spark, values), [factor(spark, f) for f in factors]
    found = T.mttkrp(table, frames, 0)
    assert "SortMergeJoin" in found._jdf.queryExecution().executedPlan().toString()
    np.testing.assert_allclose(matrix(found, "f", "idx"), mttkrp(values, factors, 0), atol=1e-12)


def test_als_update(spark, problem):
    values, factors = problem
    frames = [factor(spark, f) for f in factors]
    h = (factors[0].T @ factors[0]) * (factors[2].T @ factors[2])
    h += np.eye(3) * 0.05 * (h * h).sum() / 3
    expected = mttkrp(values, factors, 1) @ np.linalg.inv(h)
    np.testing.assert_allclose(matrix(T.als_update(cells(spark, values), frames, 1, rho=0.05), "f", "idx"), expected, atol=1e-10)


def test_pseudo_inverse_drops_small_singular_values():
    found = T.update_matrix(np.diag([4.0, 1e-7]), np.ones((2, 2)), 0.0)
    np.testing.assert_allclose(found, np.diag([0.25, 0.0]))


def gram_schmidt(a):
    q, r = np.linalg.qr(a)
    return q * np.where(np.diag(r) < 0, -1, 1)


def reference_als(values, b, c, tol, max_iter):
    factors, previous, n = [np.zeros((values.shape[0], b.shape[1])), b, c], None, 0
    while True:
        for mode in range(3):
            if max_iter and n >= max_iter:
                return factors, norms, n
            if mode == 0:
                n += 1
                if previous is not None and np.linalg.norm(factors[0] - previous) / np.linalg.norm(factors[0]) < tol:
                    return factors, norms, n
                previous = factors[0]
            p, q = [f for m, f in enumerate(factors) if m != mode]
            update = mttkrp(values, factors, mode) @ np.linalg.pinv((p.T @ p) * (q.T @ q))
            size = np.linalg.norm(update, axis=0)
            if mode == 0:
                norms = size
                factors[0] = update / size
            else:
                factors[mode] = gram_schmidt(update / size)


@pytest.mark.parametrize("max_iter", [1, 2, 3])
def test_iteration_count(spark, problem, max_iter):
    """M iterations are M updates of A and M-1 of B and C."""
    values, factors = problem
    b, c = gram_schmidt(factors[1]), gram_schmidt(factors[2])
    expected, norms, _ = reference_als(values, b, c, 0.0, max_iter)
    found = T.cp_als(cells(spark, values), 3, max_iter=max_iter, start=(factor(spark, b), factor(spark, c)))
    assert (found.n_iter, found.converged) == (max_iter, False)
    np.testing.assert_allclose(found.lambdas, norms)
    for frame, array in zip((found.a, found.b, found.c), expected):
        np.testing.assert_allclose(matrix(frame, "f", "idx"), array, atol=1e-9)


def orthogonal_tensor(rng, k):
    v, weights = gram_schmidt(rng.normal(size=(k, k))), np.linspace(3, 1, k)
    return v, weights, np.einsum("r,ir,jr,lr->ijl", weights, v, v, v)


@pytest.mark.parametrize("local_cells", [T.LOCAL_FACTOR_CELLS, 0])
def test_factors_in_arrays_and_in_tables(spark, local_cells):
    """Convergence, the weights and the components, with factors on the driver and in storage."""
    v, weights, values = orthogonal_tensor(np.random.default_rng(9), 3)
    rng = np.random.default_rng(10)
    start = [gram_schmidt(rng.normal(size=(3, 3))) for _ in range(2)]
    expected, norms, n = reference_als(values, *start, 1e-2, 12)
    found = T.cp_als(
        cells(spark, values), 3, tol=1e-2, max_iter=12, symmetric=True, local_cells=local_cells,
        start=tuple(factor(spark, f) for f in start),
    )
    assert found.n_iter == n and found.converged
    np.testing.assert_allclose(np.sort(found.lambdas)[::-1], weights, rtol=1e-3)
    np.testing.assert_allclose(found.lambdas, norms, rtol=1e-6)
    a = matrix(found.a, "f", "idx")
    overlap = np.abs(v.T @ a)
    np.testing.assert_allclose(np.sort(overlap.max(axis=0)), 1, atol=1e-3)


def test_seeded_start_is_repeatable(spark):
    _, _, values = orthogonal_tensor(np.random.default_rng(11), 3)
    one, two = (T.cp_als(cells(spark, values), 3, seed=5) for _ in range(2))
    assert one.n_iter == two.n_iter
    np.testing.assert_allclose(one.lambdas, two.lambdas, rtol=1e-9)


def test_rank_above_a_mode(spark, problem):
    with pytest.raises(ValueError, match="orthonormal"):
        T.cp_als(cells(spark, problem[0]), 6)


def test_sign_vote(spark):
    a, b, c = np.array([[1.0, 1, -1], [2, 2, 2]]), np.array([[-1.0, 1, 1], [3, 3, 3]]), np.array([[1.0, -1, 1], [4, 4, 4]])
    found = matrix(T.sign_vote(*(factor(spark, f) for f in (a, b, c))), "f", "idx")
    np.testing.assert_array_equal(found, [[-1, -1, -1], [3, 4, 2]])


def test_slices(spark):
    f = np.arange(8.0).reshape(4, 2)
    whole = factor(spark, f)
    merged = T.merge_slices(whole.where("idx < 2"), whole.where("idx >= 2"))
    np.testing.assert_array_equal(matrix(merged, "f", "idx"), f)
    with pytest.raises(PySparkException, match="more than one slice"):
        T.merge_slices(whole, whole.where("idx = 3")).collect()


@pytest.fixture
def skewed(spark):
    """Two modes of a million indexes; index 7 of the first holds a third of the cells, pair (7, 3) a sixth; repeated cells."""
    rng = np.random.default_rng(12)
    n = 3000
    i, j, l = rng.integers(0, 1_000_000, n), rng.integers(0, 1_000_000, n), rng.integers(0, 50, n)
    i[: n // 3], j[: n // 6] = 7, 3
    rows = [(*map(int, at), float(v)) for *at, v in zip(i, j, l, rng.normal(size=n))]
    table = spark.createDataFrame(rows, "i int, j int, l int, val double")
    frames = [
        spark.range(size).selectExpr("cast(id as int) AS idx", *[f"sin(id * {1.3 + r} + {m}) AS f{r}" for r in range(2)])
        for m, size in enumerate((1_000_000, 1_000_000, 50))
    ]
    return rows, table, frames


@pytest.mark.parametrize("mode", [0, 1, 2])
def test_fibres_of_long_modes(spark, skewed, mode, monkeypatch):
    """Equal to the sums cell by cell, hot indexes spread; cells are not shuffled once they are laid out."""
    rows, table, frames = skewed
    monkeypatch.setattr(fibres, "FIBRE_SPAN", 1 << 12)
    monkeypatch.setattr(fibres, "PIECE_CELLS", 64)
    cells = fibres.merged_cells(table)
    layout = fibres.Fibres(cells, mode, min_hot_rows=100)
    found = layout.mttkrp(frames)
    expected = {}
    others = [m for m in range(3) if m != mode]
    for *at, val in rows:
        value = val * np.prod([[np.sin(at[m] * (1.3 + r) + m) for r in range(2)] for m in others], axis=0)
        expected[at[mode]] = expected.get(at[mode], 0.0) + value
    got = {r["idx"]: (r["f0"], r["f1"]) for r in found.collect()}
    assert got.keys() == expected.keys()
    assert all(np.allclose(got[x], expected[x], atol=1e-10) for x in got)
    lines = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    start = next(n for n, line in enumerate(lines) if "CoGroups" in line)
    above = lines[start : next(n for n, line in enumerate(lines) if n > start and "TableCache" in line)]
    assert not any("Exchange" in line for line in above)
    sizes = layout.table.selectExpr("block", "size(b) AS n").groupBy("block").sum("n").collect()
    assert max(r[1] for r in sizes) < 0.6 * len(rows)
    layout.close()


def test_fibres_need_every_factor_row(spark, problem):
    values, factors = problem
    layout = fibres.Fibres(fibres.merged_cells(cells(spark, values)), 0)
    frames = [factor(spark, f) for f in factors]
    np.testing.assert_allclose(matrix(layout.mttkrp(frames), "f", "idx"), mttkrp(values, factors, 0), atol=1e-12)
    for short, name in ((1, "j"), (2, "l")):
        lacking = [f.where("idx != 2") if m == short else f for m, f in enumerate(frames)]
        with pytest.raises(PySparkException, match=f"no factor row for {name} = 2"):
            layout.mttkrp(lacking).collect()
    layout.close()
    none = fibres.Fibres(fibres.merged_cells(cells(spark, values).where("i > 99")), 0)
    assert none.mttkrp(frames).collect() == []
    none.close()
