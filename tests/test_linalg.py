import numpy as np
import pytest
from brute import matrix
from pyspark.sql import functions as F

from spectral_topics.functions.columns import columns_to_vec, vec_to_columns
from spectral_topics.operators import linalg


def tall(spark, values, prefix="y"):
    columns = ", ".join(f"{prefix}{j} double" for j in range(values.shape[1]))
    rows = [(i, *map(float, v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"word_id long, {columns}").repartition(3)


def gram_schmidt(a):
    q, r = np.linalg.qr(a)
    return q * np.where(np.diag(r) < 0, -1, 1)


@pytest.mark.parametrize("width", [3, 20, 120])
def test_gram_product_and_orthonormal(spark, width):
    """Generated code for narrow matrices, numpy batches for wide ones."""
    a = np.random.default_rng(1).normal(size=(2 * width + 50, width))
    df = tall(spark, a)
    np.testing.assert_allclose(linalg.gram(df, "y"), a.T @ a, atol=1e-11)
    m = np.random.default_rng(2).normal(size=(width, width))
    np.testing.assert_allclose(matrix(linalg.matmul_small(df, "y", m, "z"), "z"), a @ m, atol=1e-11)
    q = matrix(linalg.orthonormalize(df, "y"), "y")
    np.testing.assert_allclose(q, gram_schmidt(a), atol=1e-11)


@pytest.mark.parametrize("condition", [1e3, 1e9, 1e12])
def test_orthonormal_when_ill_conditioned(spark, condition):
    rng = np.random.default_rng(3)
    u, v = gram_schmidt(rng.normal(size=(80, 5))), gram_schmidt(rng.normal(size=(5, 5)))
    a = u * np.geomspace(1, 1 / condition, 5) @ v.T
    q = matrix(linalg.orthonormalize(tall(spark, a), "y"), "y")
    np.testing.assert_allclose(q.T @ q, np.eye(5), atol=1e-12)
    np.testing.assert_allclose(q[:, 0], a[:, 0] / np.linalg.norm(a[:, 0]), atol=1e-12)


def test_dependent_columns_raise(spark):
    a = np.random.default_rng(4).normal(size=(50, 3))
    with pytest.raises(ValueError, match="linearly dependent"):
        linalg.orthonormalize(tall(spark, np.column_stack([a, a[:, 0] + a[:, 1]])), "y")
    with pytest.raises(ValueError, match="linearly dependent"):
        linalg.orthonormalize(tall(spark, np.column_stack([a, np.zeros(50)])), "y")


def test_zero_column_cannot_be_normalised(spark):
    unit, norms = linalg.normalize_columns(tall(spark, np.array([[3.0, 1.0], [4.0, 0.0]])), "y")
    assert list(norms) == [5.0, 1.0]
    np.testing.assert_allclose(matrix(unit, "y"), [[0.6, 1.0], [0.8, 0.0]])
    with pytest.raises(ValueError, match="zero"):
        linalg.normalize_columns(tall(spark, np.array([[1.0, 0.0], [2.0, 0.0]])), "y")


def test_spectral_factor(spark):
    y = np.random.default_rng(6).normal(size=(60, 5)) * [5, 3, 2, 1, 0.5]
    model, sigma = linalg.spectral_factor(tall(spark, y), "y", 3)
    values, vectors = np.linalg.eigh(y.T @ y)
    expected = y @ vectors[:, ::-1][:, :3] / (values[::-1][:3] ** 0.25 + 1e-12)
    expected *= np.sign(expected[0])
    np.testing.assert_allclose(sigma, values[::-1][:3] ** 0.25)
    np.testing.assert_allclose(matrix(model, "o"), expected, atol=1e-10)


@pytest.mark.parametrize("first_row", ["zero", "absent"])
def test_spectral_sign_without_word_zero(spark, first_row):
    y = np.random.default_rng(7).normal(size=(40, 2)) * [4, 1]
    y[0] = 0
    df = tall(spark, y)
    if first_row == "absent":
        df = df.where("word_id > 0")
    found = matrix(linalg.spectral_factor(df, "y", 2)[0], "o")
    assert all(found[np.abs(found[:, j]).argmax(), j] > 0 for j in range(2))


def test_too_many_directions(spark):
    with pytest.raises(ValueError, match="sketch width"):
        linalg.spectral_factor(tall(spark, np.eye(3)), "y", 4)


def test_gaussian_depends_on_the_cell_only(spark):
    one = linalg.gaussian_matrix(spark, 4000, 5, seed=11)
    values = matrix(one, "o")
    np.testing.assert_array_equal(matrix(one.repartition(7), "o"), values)
    np.testing.assert_array_equal(matrix(linalg.gaussian_matrix(spark, 10, 4, seed=11), "o"), values[:10, :4])
    assert not np.allclose(matrix(linalg.gaussian_matrix(spark, 10, 5, seed=12), "o"), values[:10])
    flat = values.ravel()
    assert abs(flat.mean()) < 0.03 and abs(flat.std() - 1) < 0.03 and abs((flat**4).mean() - 3) < 0.3
    assert np.abs(np.corrcoef(values.T) - np.eye(5)).max() < 0.06


def test_vector_columns_round_trip(spark):
    df = tall(spark, np.arange(6.0).reshape(3, 2))
    vec = columns_to_vec(df, "y")
    assert sorted(map(tuple, vec_to_columns(vec, "y", 2).collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(Exception, match="expected 3"):
        vec_to_columns(vec, "y", 3).select(F.sum("y0")).collect()
