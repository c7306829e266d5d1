"""Tall matrices are DataFrames with one key column and numbered DOUBLE columns (y0, y1, ...)."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Driver-side matrices up to this many cells are written into a query as constants.
CONSTANT_CELLS = 5_000


def named(prefix: str, width: int) -> list[str]:
    return [f"{prefix}{j}" for j in range(width)]


def matrix_columns(df: DataFrame, prefix: str) -> list[str]:
    """The columns ``prefix0 .. prefixN`` of ``df`` in numeric order; a gap is an error."""
    pattern = re.compile(rf"{re.escape(prefix)}(\d+)$")
    found = {int(m[1]): name for name in df.columns if (m := pattern.match(name))}
    if not found or sorted(found) != list(range(len(found))):
        raise ValueError(f"expected columns {prefix}0, {prefix}1, ... in {df.columns}")
    return [found[j] for j in range(len(found))]


def literal(value: float) -> str:
    """A DOUBLE literal in SQL text that reads back as exactly ``value``."""
    value = float(value)
    if not math.isfinite(value):
        raise ValueError(f"matrix entry is not finite: {value}")
    return f"{value!r}D"


def constants(values: Iterable[float]) -> str:
    """A constant ARRAY<DOUBLE> in SQL text."""
    return f"array({', '.join(map(literal, values))})"


def combination(columns: Sequence[str], weights: Sequence[float]) -> Column:
    """Linear combination of columns with driver-side weights."""
    return F.expr(" + ".join(f"{c} * ({literal(w)})" for c, w in zip(columns, weights)))


def vec_to_columns(df: DataFrame, prefix: str, width: int, vec: str = "vec") -> DataFrame:
    """Split an ARRAY<DOUBLE> of known width into numbered columns; another width is an error."""
    checked = F.when(F.size(vec) == width, F.col(vec)).otherwise(
        F.raise_error(F.format_string("row has %d values, expected " + str(width), F.size(vec)))
    )
    kept = [c for c in df.columns if c != vec]
    return df.withColumn(vec, checked).select(
        *kept, *[F.col(vec)[j].alias(f"{prefix}{j}") for j in range(width)]
    )


def columns_to_vec(df: DataFrame, prefix: str, vec: str = "vec") -> DataFrame:
    columns = matrix_columns(df, prefix)
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.array(*columns).alias(vec))


def columns_to_cells(df: DataFrame, prefix: str, index: str, value: str) -> DataFrame:
    """One row per matrix cell: the other columns, the column number and the value."""
    columns = matrix_columns(df, prefix)
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.posexplode(F.array(*columns)).alias(index, value))


def row_to_cells(row: DataFrame, fields: Sequence[str], cells: Sequence[tuple[Sequence, str]]) -> DataFrame:
    """Unpivot a one-row aggregate: ``cells`` pairs literal keys with the column holding the value."""
    structs = [
        F.struct(*[F.lit(k).alias(f) for f, k in zip(fields, keys)], F.col(column).alias("val"))
        for keys, column in cells
    ]
    return row.select(F.inline(F.array(*structs)))
