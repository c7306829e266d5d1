"""Numpy work on Arrow batches inside Spark tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame


def numpy_batches(
    df: DataFrame, function: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str
) -> DataFrame:
    """``mapInPandas`` with one BLAS thread per task, since Spark already runs a task per core.

    More threads than cores slow each other down, and a thread pool in a forked worker can hang.
    """
    one_thread(df)
    return df.mapInPandas(function, schema)


def arrow_batches(
    df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """``mapInArrow`` with one BLAS thread per task."""
    one_thread(df)
    return df.mapInArrow(function, schema)


def one_thread(df: DataFrame) -> None:
    """One BLAS thread in Python workers."""
    environment = df.sparkSession.sparkContext.environment
    for name in ("OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS", "OMP_NUM_THREADS"):
        environment.setdefault(name, "1")


def merge_small_partitions(df: DataFrame) -> DataFrame:
    """Merge input partitions when there are many more than cores: fewer partial matrices to add."""
    spark = df.sparkSession
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.coalesce(max(shuffle, 2 * spark.sparkContext.defaultParallelism))
