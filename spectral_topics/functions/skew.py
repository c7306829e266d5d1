"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A key is hot when it holds more than 1/MAX_HOT_KEYS of all rows, so there are never more of them.
MAX_HOT_KEYS = 10_000
# Below this many rows one task handles a key comfortably.
MIN_HOT_ROWS = 1_000_000

_UNITS = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30}


def broadcast_limit(spark: SparkSession) -> int:
    """``spark.sql.autoBroadcastJoinThreshold`` in bytes; -1 switches broadcasting off."""
    text = spark.conf.get("spark.sql.autoBroadcastJoinThreshold").strip().lower()
    number, unit = re.fullmatch(r"(-?\d+)\s*([a-z]*)", text).groups()
    return int(number) * _UNITS[unit]


def fits_broadcast(spark: SparkSession, rows: int, doubles: int) -> bool:
    return rows * (16 + 8 * doubles) <= broadcast_limit(spark)


def hot_keys(df: DataFrame, key: str, limit: Callable[[int], int] | None = None) -> tuple[int, DataFrame | None]:
    """The number of rows, and the keys holding more than ``limit(rows)`` of them.

    By default a key is hot with more than MIN_HOT_ROWS and 1/MAX_HOT_KEYS of all rows. The keys
    are a small local table (fewer than rows / limit), None when no key is hot.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total, largest = counts.agg(F.sum("n"), F.max("n")).first()
    total = total or 0
    most = limit(total) if limit else max(MIN_HOT_ROWS, total // MAX_HOT_KEYS)
    if largest is None or largest <= most:
        return total, None
    found = counts.where(F.col("n") > most).select(key).collect()
    return total, df.sparkSession.createDataFrame(found, df.select(key).schema)


def skew_safe_join(
    big: DataFrame,
    table: DataFrame,
    key: str,
    rows: int,
    doubles: int,
    spread_by: Column,
    pieces: int | None = None,
    how: str = "inner",
) -> DataFrame:
    """Join ``big`` with ``table`` (unique on ``key``).

    A table within the broadcast limit is broadcast. A larger one is joined by a shuffle in
    which rows of hot keys are spread over ``pieces`` by the hash of ``spread_by`` and the
    matching table rows (at most MAX_HOT_KEYS) are repeated for each piece.
    """
    spark = big.sparkSession
    if fits_broadcast(spark, rows, doubles):
        return big.join(F.broadcast(table), key, how)
    hot = hot_keys(big, key)[1]
    if hot is None:
        return big.join(table, key, how)
    pieces = pieces or int(spark.conf.get("spark.sql.shuffle.partitions"))
    marked = F.broadcast(hot.withColumn("is_hot", F.lit(True)))
    left = big.join(marked, key, "left").withColumn(
        "piece", F.when(F.col("is_hot"), F.pmod(F.xxhash64(spread_by), F.lit(pieces)).cast("int")).otherwise(0)
    )
    last = F.when(F.col("is_hot"), F.lit(pieces - 1)).otherwise(0)
    right = table.join(marked, key, "left").withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    return left.drop("is_hot").join(right.drop("is_hot"), [key, "piece"], how).drop("piece")
