"""CP decomposition of an order-3 tensor stored as cells ``(i, j, l, val)``.

Factors are tall matrices ``(idx, f0, f1, ...)``. ``cp_als`` keeps factors of small modes as
driver arrays and those of long modes as tables in shared storage, next to three layouts of the tensor (fibres.py).
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectral_topics.functions.batches import numpy_batches
from spectral_topics.functions.columns import matrix_columns, named
from spectral_topics.functions.dense import one_blas_thread
from spectral_topics.functions.skew import skew_safe_join
from spectral_topics.functions.storage import materialize
from spectral_topics.operators.fibres import MODES, Fibres, merged_cells
from spectral_topics.operators.linalg import (
    INDEPENDENT,
    gaussian_matrix,
    gram,
    matmul_small,
    normalize_columns,
    orthonormalize,
    require_nonzero,
)

# Singular values below this are treated as zero in the pseudo-inverse (fixed value).
PINV_TOLERANCE = 1e-6
# Factors up to this many cells are kept on the driver between updates.
LOCAL_FACTOR_CELLS = 1_000_000


def other_modes(mode: int) -> tuple[int, int]:
    first, second = [m for m in range(3) if m != mode]
    return first, second


def lookup_factors(
    tensor: DataFrame, factors: Sequence[DataFrame | None], mode: int, sizes: Sequence[int] | None = None
) -> DataFrame:
    """Attach to every cell the factor rows of the two other modes, as columns p0.. and q0...

    ``sizes`` gives the row counts of the factors if known. A cell without a factor row fails the job.
    """
    joined = tensor
    for name, other in zip("pq", other_modes(mode)):
        factor, index = factors[other], MODES[other]
        cols = matrix_columns(factor, "f")
        side = factor.select(F.col("idx").alias(index), *[F.col(c).alias(f"{name}{r}") for r, c in enumerate(cols)])
        rows = sizes[other] if sizes else factor.count()
        spread_by = F.struct(*[m for m in MODES if m != index])
        joined = skew_safe_join(joined, side, index, rows, len(cols), spread_by, how="left")
        missing = F.raise_error(F.concat(F.lit(f"no factor row for {index} = "), F.coalesce(F.col(index).cast("string"), F.lit("null"))))
        joined = joined.withColumn(f"{name}0", F.coalesce(f"{name}0", missing.cast("double")))
    return joined


def mttkrp(
    tensor: DataFrame, factors: Sequence[DataFrame | None], mode: int, sizes: Sequence[int] | None = None
) -> DataFrame:
    """``(idx, f0, ...)``: sum over the other two modes of val * factor * factor."""
    rank = len(matrix_columns(factors[other_modes(mode)[0]], "f"))
    rows = lookup_factors(tensor, factors, mode, sizes)
    return rows.groupBy(F.col(MODES[mode]).alias("idx")).agg(
        *[F.sum(F.expr(f"val * p{r} * q{r}")).alias(f"f{r}") for r in range(rank)]
    )


def mttkrp_arrays(tensor: DataFrame, factors: Sequence[np.ndarray | None], mode: int, rows: int) -> np.ndarray:
    """``mttkrp`` with small factors given as arrays, without a join: one array of ``rows`` rows.

    Every task adds up its cells in one array and sends its nonzero rows. An index without cells is
    a zero row; a cell without a factor row fails the job.
    """
    first, second = (factors[m] for m in other_modes(mode))
    a, b = (MODES[m] for m in other_modes(mode))
    rank = first.shape[1]
    names = named("f", rank)
    shared = tensor.sparkSession.sparkContext.broadcast((first, second))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left, right = shared.value
        sums = np.zeros((rows, rank))
        for batch in batches:
            at = [batch[m].to_numpy() for m in ("idx", "a", "b")]
            for index, size, name in zip(at, (rows, len(left), len(right)), (MODES[mode], a, b)):
                if len(index) and not ((index >= 0) & (index < size)).all():
                    raise ValueError(f"no factor row for a cell's {name}: the factor has {size} rows")
            terms = left[at[1]] * right[at[2]] * batch["val"].to_numpy()[:, None]
            for r in range(rank):
                sums[:, r] += np.bincount(at[0], terms[:, r], rows)
        used = np.flatnonzero((sums != 0).any(axis=1))
        out = pd.DataFrame(sums[used], columns=names)
        out.insert(0, "idx", used)
        yield out

    cells = tensor.select(F.col(MODES[mode]).alias("idx"), F.col(a).alias("a"), F.col(b).alias("b"), "val")
    schema = "idx long, " + ", ".join(f"{n} double" for n in names)
    parts = numpy_batches(cells, partial, schema).groupBy("idx").agg(*[F.sum(n).alias(n) for n in names])
    found = parts.toPandas()
    shared.destroy()
    out = np.zeros((rows, rank))
    out[found["idx"].to_numpy(np.int64)] = found[names].to_numpy(float)
    return out


def update_matrix(first: np.ndarray, second: np.ndarray, rho: float) -> np.ndarray:
    """Pseudo-inverse of the ridge-regularised Hadamard product of two Gram matrices."""
    product = first * second
    k = len(product)
    product = product + np.eye(k) * (rho * float((product * product).sum()) / k)
    u, s, vt = np.linalg.svd(product)
    inverse = np.where(s < PINV_TOLERANCE, 0.0, 1.0 / np.where(s < PINV_TOLERANCE, 1.0, s))
    return (vt.T * inverse) @ u.T


def als_update(
    tensor: DataFrame,
    factors: Sequence[DataFrame | None],
    mode: int,
    rho: float = 0.0,
    sizes: Sequence[int] | None = None,
) -> DataFrame:
    """``(idx, f0, ...)``: the least-squares update of one factor, the other two held fixed."""
    first, second = (factors[m] for m in other_modes(mode))
    weights = update_matrix(gram(first, "f"), gram(second, "f"), rho)
    return matmul_small(mttkrp(tensor, factors, mode, sizes), "f", weights, "f", key="idx")


def merge_slices(*slices: DataFrame, prefix: str = "f", key: str = "idx") -> DataFrame:
    """Union of row slices of one factor; an index in two slices fails the job."""
    merged = slices[0]
    for other in slices[1:]:
        merged = merged.unionByName(other)
    cols = matrix_columns(merged, prefix)
    once = merged.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[F.max(c).alias(c) for c in cols])
    unique = F.when(F.col("n") == 1, True).otherwise(
        F.raise_error(F.concat(F.lit("row index in more than one slice: "), F.col(key).cast("string")))
    )
    return once.where(unique).select(key, *cols)


def vote_signs(first_rows: Sequence[np.ndarray]) -> list[int]:
    """Which factor (0, 1, 2) supplies each column of A, from the first rows of the three factors."""
    a, b, c = (np.sign(row) for row in first_rows)
    return [1 if x == z != y else 2 if x == y != z else 0 for x, y, z in zip(a, b, c)]


def sign_vote(a: DataFrame, b: DataFrame, c: DataFrame) -> DataFrame:
    """Columns of A, replaced by B's or C's column when that factor's first entry alone has the other sign.

    Only meaningful for a symmetric tensor, whose factors agree up to sign.
    """
    cols = matrix_columns(a, "f")
    zeros = [0.0] * len(cols)
    first_rows = [np.array(f.where(F.col("idx") == 0).select(*cols).first() or zeros, dtype=float) for f in (a, b, c)]
    # A row that a factor lacks is a zero row.
    sides = [f.select("idx", *[F.col(col).alias(f"a{n}_{col}") for col in cols]) for n, f in enumerate((a, b, c))]
    joined = sides[0].join(sides[1], "idx", "full").join(sides[2], "idx", "full")
    chosen = [F.coalesce(f"a{source}_{col}", F.lit(0.0)).alias(col) for source, col in zip(vote_signs(first_rows), cols)]
    return joined.select("idx", *chosen)


@dataclass(frozen=True)
class CPResult:
    """Factors as tables ``(idx, f0, ...)``, the weights, and how the loop ended."""

    a: DataFrame
    b: DataFrame
    c: DataFrame
    lambdas: np.ndarray
    n_iter: int
    converged: bool


class LocalFactor:
    """A factor of a short mode, kept as a driver array."""

    def __init__(self, spark: SparkSession, values: np.ndarray):
        self.spark, self.values = spark, np.asarray(values, dtype=float)

    @property
    def table(self) -> DataFrame:
        frame = pd.DataFrame(self.values, columns=named("f", self.values.shape[1]))
        frame.insert(0, "idx", np.arange(len(frame), dtype="int32"))
        return self.spark.createDataFrame(frame)

    def gram(self) -> np.ndarray:
        return self.values.T @ self.values

    def updated(self, sums: np.ndarray, weights: np.ndarray) -> LocalFactor:
        return LocalFactor(self.spark, sums @ weights)

    def normalized(self) -> tuple[LocalFactor, np.ndarray]:
        norms = np.linalg.norm(self.values, axis=0)
        require_nonzero(norms)
        return LocalFactor(self.spark, self.values / norms), norms

    def orthonormal(self) -> LocalFactor:
        q, r = np.linalg.qr(self.values)
        require_independent(np.abs(np.diag(r)), np.linalg.norm(self.values, axis=0))
        return LocalFactor(self.spark, q * np.where(np.diag(r) < 0, -1.0, 1.0))

    def change(self, previous: LocalFactor) -> float:
        return float(np.linalg.norm(self.values - previous.values) / np.linalg.norm(self.values))


class TableFactor:
    """A factor of a long mode, kept as a table in shared storage."""

    def __init__(self, table: DataFrame, rows: int):
        self.table, self.rows = table, rows
        self.columns = matrix_columns(table, "f")

    def gram(self) -> np.ndarray:
        return gram(self.table, "f")

    def updated(self, sums: DataFrame, weights: np.ndarray) -> TableFactor:
        """``sums`` may lack indexes without cells; they become zero rows, as in arrays."""
        found = matmul_small(sums, "f", weights, "f", key="idx")
        every = found.sparkSession.range(self.rows).select(F.col("id").cast(found.schema["idx"].dataType).alias("idx"))
        filled = every.join(found, "idx", "left").select("idx", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in self.columns])
        return TableFactor(materialize(filled, "factor"), self.rows)

    def normalized(self) -> tuple[TableFactor, np.ndarray]:
        table, norms = normalize_columns(self.table, "f", key="idx")
        return TableFactor(table, self.rows), norms

    def orthonormal(self) -> TableFactor:
        return TableFactor(materialize(orthonormalize(self.table, "f", key="idx"), "factor"), self.rows)

    def change(self, previous: TableFactor) -> float:
        old = previous.table.toDF("idx", *[f"old_{c}" for c in self.columns])
        both = self.table.join(old, "idx", "full").na.fill(0.0)
        squares = [
            F.sum(sum((F.col(c) - F.col(f"old_{c}")) ** 2 for c in self.columns)),
            F.sum(sum(F.col(c) ** 2 for c in self.columns)),
        ]
        moved, size = both.agg(*squares).first()
        return float(np.sqrt(moved / size))


def _start(spark: SparkSession, given: DataFrame | None, rows: int, rank: int, seed: int, local: bool):
    """The given start, or an orthonormalised Gaussian one."""
    table = given if given is not None else gaussian_matrix(spark, rows, rank, seed, prefix="f", key="idx")
    if local:
        values = np.zeros((rows, rank))
        for row in table.select("idx", *named("f", rank)).collect():
            values[row[0]] = row[1:]
        factor = LocalFactor(spark, values)
    else:
        factor = TableFactor(materialize(table, "factor"), rows)
    return factor if given is not None else factor.orthonormal()


def cp_als(
    tensor: DataFrame,
    rank: int,
    tol: float = 1e-4,
    max_iter: int = 0,
    rho: float = 0.0,
    seed: int = 20_011,
    start: tuple[DataFrame, DataFrame] | None = None,
    symmetric: bool = False,
    shape: tuple[int, int, int] | None = None,
    hard_cap: int | None = None,
    local_cells: int = LOCAL_FACTOR_CELLS,
) -> CPResult:
    """Rank-``rank`` CP decomposition by alternating least squares.

    Factors are updated in the order A, B, C; every update is normalised, B and C are also
    orthonormalised. The loop stops when A changes by less than ``tol`` between iterations, or
    with ``max_iter=M`` after M updates of A and M-1 of B and C (0: until converged). ``hard_cap``
    bounds a run until convergence; a run that it ends gives a warning. ``start`` gives the first B
    and C. ``symmetric`` applies the sign vote to A. A cell outside ``shape`` is an error.
    """
    one_blas_thread()
    spark = tensor.sparkSession
    tensor = materialize(tensor.select("i", "j", "l", "val"), "tensor").persist()
    layouts: list[Fibres] = []
    try:
        shape = _checked_shape(tensor, shape)
        if rank > min(shape[1:]):
            raise ValueError(f"rank {rank} exceeds a mode of {shape}: B and C must hold orthonormal columns")
        local = max(shape) * rank <= local_cells
        b_start, c_start = start or (None, None)
        factors = [
            None,
            _start(spark, b_start, shape[1], rank, seed, local),
            _start(spark, c_start, shape[2], rank, seed + 1, local),
        ]
        if not local:
            cells = materialize(merged_cells(tensor), "cells")
            layouts += [Fibres(cells, mode) for mode in range(3)]
            tensor.unpersist()
        empty_a = LocalFactor(spark, np.zeros((shape[0], rank))) if local else None
        lambdas, previous, converged, n_iter = np.zeros(rank), None, False, 0
        limit = max_iter if max_iter > 0 else hard_cap
        while not converged and (limit is None or n_iter < limit):
            n_iter += 1
            if previous is not None and n_iter > 2 and factors[0].change(previous) < tol:
                converged = True
                break
            previous = factors[0] or empty_a
            factors[0], lambdas = _updated(tensor, layouts, factors, 0, rho, shape, empty_a)
            if n_iter == limit:
                break
            for mode in (1, 2):
                factors[mode] = _updated(tensor, layouts, factors, mode, rho, shape, factors[mode])[0].orthonormal()
        if not converged and max_iter <= 0:
            warnings.warn(f"stopped after {n_iter} iterations without convergence", stacklevel=2)
        a, b, c = (f.table for f in factors)
        if symmetric and local:
            chosen = vote_signs([f.values[0] for f in factors])
            columns = [factors[source].values[:, r] for r, source in enumerate(chosen)]
            a = LocalFactor(spark, np.column_stack(columns)).table
        elif symmetric:
            a = sign_vote(a, b, c)
        return CPResult(a, b, c, lambdas, n_iter, converged)
    finally:
        tensor.unpersist()
        for layout in layouts:
            layout.close()


def _checked_shape(tensor: DataFrame, shape: tuple[int, int, int] | None) -> tuple[int, int, int]:
    """The given shape, or that of the largest indexes; every cell must lie inside."""
    bounds = [f(m) for m in MODES for f in (F.min, F.max)] + [F.count_if(F.col(m).isNull()) for m in MODES]
    row = tensor.agg(*bounds).first()
    low, high, absent = row[0:6:2], row[1:6:2], row[6:]
    shape = shape or tuple((v or 0) + 1 for v in high)
    for m, least, most, size, nulls in zip(MODES, low, high, shape, absent):
        if nulls or (least is not None and not 0 <= least <= most < size):
            raise ValueError(f"cells with {m} from {least} to {most} and {nulls} nulls do not fit a mode of {size} rows")
    return shape


def require_independent(diagonal: np.ndarray, norms: np.ndarray) -> None:
    if (diagonal <= INDEPENDENT * norms).any():
        raise ValueError(f"the {len(diagonal)} columns are linearly dependent; use a smaller rank")


def _updated(tensor, layouts, factors, mode, rho, shape, holder):
    """One normalised factor update; ``holder`` says where the result is kept, ``layouts`` serve factors in tables."""
    first, second = other_modes(mode)
    weights = update_matrix(factors[first].gram(), factors[second].gram(), rho)
    fixed = [None if m == mode else f for m, f in enumerate(factors)]
    if isinstance(fixed[first], LocalFactor):
        sums = mttkrp_arrays(tensor, [f and f.values for f in fixed], mode, shape[mode])
    else:
        sums = layouts[mode].mttkrp([f and f.table for f in fixed])
    holder = holder or TableFactor(factors[first].table, shape[mode])
    return holder.updated(sums, weights).normalized()
