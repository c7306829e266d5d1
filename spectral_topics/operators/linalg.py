"""Linear algebra on tall tables. Only matrices of column-count size reach the driver."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spectral_topics.functions.batches import merge_small_partitions, numpy_batches
from spectral_topics.functions.columns import combination, literal, matrix_columns, named, row_to_cells
from spectral_topics.functions.dense import one_blas_thread

# Wider work goes through numpy per Arrow batch instead of one generated expression per cell.
MAX_SUM_COLUMNS = 160
MAX_PRODUCT_TERMS = 1024


def gaussian_matrix(spark: SparkSession, rows: int, cols: int, seed: int, prefix: str = "o", key: str = "word_id") -> DataFrame:
    """Standard normals that depend on (seed, row, column) only, not on the partitioning.

    Each pair of columns is one Box-Muller draw on the two halves of an MD5 digest.
    """
    pairs, scale = (cols + 1) // 2, 1 << 52
    digests = F.transform(
        F.sequence(F.lit(0), F.lit(pairs - 1)), lambda p: F.md5(F.concat_ws(":", F.lit(seed), F.col("id"), p))
    )

    def uniform(digest: Column, start: int) -> Column:
        return F.conv(F.substring(digest, start, 13), 16, 10).cast("double")  # 52 bits

    def polar(digest: Column) -> Column:
        radius = F.sqrt(-2.0 * F.log((uniform(digest, 1) + 1.0) / float(scale)))
        return F.struct(radius.alias("r"), (uniform(digest, 14) * (2.0 * math.pi / scale)).alias("t"))

    drawn = spark.range(rows).select("id", F.transform(digests, polar).alias("draws"))
    values = [
        F.col("draws")[j // 2]["r"] * (F.sin if j % 2 else F.cos)(F.col("draws")[j // 2]["t"]) for j in range(cols)
    ]
    return drawn.select(F.col("id").alias(key), *[v.alias(f"{prefix}{j}") for j, v in enumerate(values)])


def gram_table(df: DataFrame, prefix: str) -> DataFrame:
    """Cells ``(a, b, val)``, a <= b, of the matrix of column dot products."""
    cols = matrix_columns(df, prefix)
    cells = [(a, b) for a in range(len(cols)) for b in range(a, len(cols))]
    if len(cells) <= MAX_SUM_COLUMNS:
        row = df.agg(*[F.sum(F.col(cols[a]) * F.col(cols[b])).alias(f"g{n}") for n, (a, b) in enumerate(cells)])
        return row_to_cells(row, ("a", "b"), [(cell, f"g{n}") for n, cell in enumerate(cells)])

    width = len(cols)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for batch in batches:
            y = batch.to_numpy(dtype=float)
            total += y.T @ y
        a, b = np.triu_indices(width)
        yield pd.DataFrame({"a": a.astype("int32"), "b": b.astype("int32"), "val": total[a, b]})

    parts = numpy_batches(merge_small_partitions(df.select(*cols)), partial, "a int, b int, val double")
    return parts.groupBy("a", "b").agg(F.sum("val").alias("val"))


def gram(df: DataFrame, prefix: str) -> np.ndarray:
    one_blas_thread()
    width = len(matrix_columns(df, prefix))
    out = np.zeros((width, width))
    for a, b, val in gram_table(df, prefix).collect():
        out[a, b] = out[b, a] = val or 0.0
    return out


def matmul_small(df: DataFrame, prefix: str, matrix: np.ndarray, out_prefix: str, key: str = "word_id") -> DataFrame:
    """``(key, out0, ...)``: the tall matrix times a small driver-side matrix."""
    cols = matrix_columns(df, prefix)
    matrix = np.asarray(matrix, dtype=float)
    if matrix.shape[0] != len(cols):
        raise ValueError(f"{len(cols)} columns cannot be multiplied by a {matrix.shape} matrix")
    if not np.isfinite(matrix).all():
        raise ValueError("the small matrix holds values that are not finite")
    outs = named(out_prefix, matrix.shape[1])
    if matrix.size <= MAX_PRODUCT_TERMS:
        return df.select(key, *[combination(cols, matrix[:, j]).alias(o) for j, o in enumerate(outs)])

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            product = pd.DataFrame(batch[cols].to_numpy(dtype=float) @ matrix, columns=outs)
            product.insert(0, key, batch[key].to_numpy())
            yield product

    key_type = df.schema[key].dataType.simpleString()
    schema = f"{key} {key_type}, " + ", ".join(f"{o} double" for o in outs)
    return numpy_batches(df.select(key, *cols), multiply, schema)


# A column is independent of those before it if this share of its norm, or more, is new.
INDEPENDENT = 1e-13


def column_norms(df: DataFrame, prefix: str) -> DataFrame:
    """``(a, val)``: the 2-norm of every column."""
    cols = matrix_columns(df, prefix)
    row = df.agg(*[F.sqrt(F.sum(F.col(c) * F.col(c))).alias(c) for c in cols])
    return row_to_cells(row, ("a",), [((a,), c) for a, c in enumerate(cols)])


def normalize_columns(df: DataFrame, prefix: str, key: str = "word_id") -> tuple[DataFrame, np.ndarray]:
    """Columns divided by their 2-norm, and the norms. A zero column is an error."""
    cols = matrix_columns(df, prefix)
    norms = np.zeros(len(cols))
    for a, val in column_norms(df, prefix).collect():
        norms[a] = val or 0.0
    require_nonzero(norms)
    return df.select(key, *[(F.col(c) / F.lit(float(n))).alias(c) for c, n in zip(cols, norms)]), norms


def require_nonzero(norms: np.ndarray) -> None:
    if not (norms > 0).all():
        raise ValueError(f"columns {np.flatnonzero(~(norms > 0)).tolist()} are zero and cannot be normalised")


def orthonormalize(df: DataFrame, prefix: str, key: str = "word_id") -> DataFrame:
    """Orthonormal columns spanning the same nested subspaces (the Gram-Schmidt result).

    Repeated Cholesky QR: each pass needs one Gram matrix, two passes suffice for ordinary
    conditioning. When Cholesky fails a shifted pass improves the conditioning first (Fukaya
    et al., "Shifted Cholesky QR", SIAM J. Sci. Comput. 2020). Scans ``df`` once per pass, so
    pass a materialised table.
    """
    width = len(matrix_columns(df, prefix))
    product = gram(df, prefix)
    scale = np.sqrt(np.diag(product))
    diagonal = np.ones(width)
    current = df
    for _ in range(6):
        near = np.abs(product - np.eye(width)).max() < 0.1
        upper = _cholesky_upper(product, width)
        diagonal *= np.diag(upper)
        current = matmul_small(current, prefix, np.linalg.inv(upper), prefix, key)
        if near:
            if (diagonal <= INDEPENDENT * scale).any():
                break
            return current
        product = gram(current, prefix)
    raise ValueError(f"the {width} columns are linearly dependent; use a smaller k_prime")


def _cholesky_upper(product: np.ndarray, width: int) -> np.ndarray:
    if not (np.diag(product) > 0).all():
        raise ValueError(f"the {width} columns are linearly dependent; use a smaller k_prime")
    try:
        return np.linalg.cholesky(product).T
    except np.linalg.LinAlgError:
        shift = 11.0 * width * (width + 1) * np.finfo(float).eps * np.linalg.norm(product, 2)
        return np.linalg.cholesky(product + shift * np.eye(width)).T


def spectral_factor(y: DataFrame, prefix: str, k: int, out_prefix: str = "o", key: str = "word_id") -> tuple[DataFrame, np.ndarray]:
    """The k leading spectral directions of the tall matrix and their scales.

    With eigenpairs (e, v) of YᵀY, sigma = max(e, 0)^(1/4) and the columns are Y v / (sigma + 1e-12),
    largest sigma first. A column is flipped so that its entry for key 0 is not negative; where
    that entry is zero or absent the entry of largest magnitude decides.
    """
    width = len(matrix_columns(y, prefix))
    if not 1 <= k <= width:
        raise ValueError(f"k={k} must be between 1 and the sketch width {width}")
    values, vectors = np.linalg.eigh(gram(y, prefix))
    sigma = np.maximum(values, 0.0) ** 0.25
    order = np.argsort(-sigma, kind="stable")[:k]
    sigma = sigma[order]
    weights = vectors[:, order] / (sigma + 1e-12)

    cols = matrix_columns(y, prefix)
    first = y.where(F.col(key) == 0).select(*cols).first()
    signs = np.sign(np.array(first, dtype=float) @ weights) if first else np.zeros(k)
    if (signs == 0).any():
        product = matmul_small(y, prefix, weights, "v", key)
        extreme = product.agg(
            *[F.max_by(f"v{j}", F.struct(F.abs(f"v{j}"), -F.col(key))).alias(f"v{j}") for j in range(k)]
        ).first()
        signs = np.where(signs == 0, np.where(np.array(extreme, dtype=float) < 0, -1.0, 1.0), signs)
    return matmul_small(y, prefix, weights * signs, out_prefix, key), sigma


def scale_projection(proj: DataFrame, sigma: np.ndarray, ridge: float = 1e-6, prefix: str = "x") -> DataFrame:
    """Divide column j by sigma_j + ridge * sigma_0."""
    cols = matrix_columns(proj, prefix)
    kept = [c for c in proj.columns if c not in cols]
    divisors = ridged(sigma, ridge)
    return proj.select(*kept, *[F.expr(f"{c} / {literal(s)}").alias(c) for c, s in zip(cols, divisors)])


def ridged(sigma: np.ndarray, ridge: float = 1e-6) -> np.ndarray:
    return np.asarray(sigma, dtype=float) + ridge * float(sigma[0])
