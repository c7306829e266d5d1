"""What the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spectral_topics.functions.storage import shared_folder

#: A key holding more than 1/HOT_SHARE of all rows is hot, so there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, text)``: only the two columns, so no other name can clash; a null text is empty."""
    return df.select(
        quoted(id_col).cast("long").alias("id"), F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("text")
    )


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def crc_bucket(id_col: str, n: int) -> Column:
    """crc32 of the id written as text, modulo n; a null id is written as the empty text."""
    return F.pmod(F.crc32(F.coalesce(quoted(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(n))


HASHES = 1 << 40


def hash_share(column: str, share: Column | float) -> Column:
    """Whether a row's hash is among the lowest ``share`` of all hashes: about that share of the rows, the same ones each time."""
    return F.pmod(F.xxhash64(column, F.lit(11)), F.lit(HASHES)) <= F.lit(float(HASHES)) * share


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, spread_by: str) -> DataFrame:
    """Inner join of ``rows`` with ``groups`` (one row per ``key``, its number of rows in ``size``).

    Every row has its group. Keys that hold more than 1/HOT_SHARE of the rows number fewer than
    HOT_SHARE whatever the input, so they are broadcast; their rows get keys of their own in the
    shuffle join of the others and spread over all tasks. Pass stored groups: they are read three times.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    carried = [c for c in groups.columns if c != key]
    packed = groups.select(key, size, F.struct(*carried).alias("group"))
    hot = F.col(size) > F.lit(total // HOT_SHARE)
    few = packed.where(hot & (F.col(size) > 1)).select(key, F.col("group").alias("hot_group"))
    rest = packed.where(~hot | (F.col(size) <= 1)).select(F.col(key).cast("string").alias("rest_key"), F.col("group").alias("rest_group"))
    marked = rows.join(F.broadcast(few), key, "left").withColumn(
        "rest_key",
        F.when(F.col("hot_group").isNull(), F.col(key).cast("string")).otherwise(F.concat_ws(" hot ", F.col(key), F.col(spread_by))),
    )
    return (
        marked.join(rest, "rest_key", "left")
        .withColumn("group", F.coalesce("hot_group", "rest_group"))
        .select(*rows.columns, *[F.col(f"group.{c}").alias(c) for c in carried])
    )


#: Bits that ``maybe_among`` hashes keys to: 2 MB, whatever the input.
FILTER_BITS = 1 << 24


def maybe_among(rows: DataFrame, keys: DataFrame, on: list[str], bits: int = FILTER_BITS) -> DataFrame:
    """``rows`` without most of those whose key isn't in ``keys``, and with all whose key is.

    Put before a join, it spares the shuffle of rows that find no partner. Keys are hashed to the bits of a
    broadcast bitmap; with far more keys than bits few rows go. For keys without nulls.
    """
    place = F.pmod(F.xxhash64(*on), F.lit(bits))
    marks = keys.select(F.bitmap_bucket_number(place).alias("__part"), F.bitmap_bit_position(place).alias("__at"))
    bitmap = marks.groupBy("__part").agg(F.bitmap_construct_agg("__at").alias("__bitmap"))
    placed = rows.withColumn("__part", F.bitmap_bucket_number(place)).withColumn("__at", F.bitmap_bit_position(place))
    byte = F.conv(F.hex(F.substr("__bitmap", (F.floor(F.col("__at") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = placed.join(F.broadcast(bitmap), "__part").where(F.getbit(byte, (F.col("__at") % 8).cast("int")) == 1)
    return found.select(*[quoted(c) for c in rows.columns])


#: Rows sent to a Python worker at a time; Spark's own default suits rows of numbers rather than texts.
BATCH_ROWS = 1000
_BATCH_SETTING, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def run_lean(df: DataFrame) -> None:
    """One thread for each Python worker, as Spark already runs a task on each core, and small batches.

    The session's batch size is lowered where it has its default, so a size of the user's own stays.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH_SETTING) == _BATCH_DEFAULT:
        conf.set(_BATCH_SETTING, str(BATCH_ROWS))
    environment = df.sparkSession.sparkContext.environment
    for name in ("OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS", "OMP_NUM_THREADS", "RAYON_NUM_THREADS"):
        environment.setdefault(name, "1")
    environment.setdefault("TOKENIZERS_PARALLELISM", "false")


_kept: dict = {}


def worker_memory(key, make):
    """What a Python worker keeps from task to task, one thing at a time: another key drops what was kept, and its memory goes back."""
    if key not in _kept:
        _kept.clear()
        give_back()
        _kept[key] = make()
    return _kept[key]


def forget() -> None:
    """Drop what this worker keeps for another operator; for functions that keep nothing."""
    worker_memory(None, lambda: None)


def give_back() -> None:
    """Return freed memory of this process to the system; allocators keep it otherwise, for as long as it lives."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def arrow_map(df: DataFrame, function, schema) -> DataFrame:
    run_lean(df)
    return df.mapInArrow(function, schema)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text, a null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, each with at most ``limit`` bytes in ``column`` or a single row."""
    texts = batch.column(column)
    lengths = np.fromiter((len(x) for x in text_bytes(texts)), np.int64, len(texts))
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(texts):
        yield batch.slice(start)


@contextlib.contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of each query inside as soon as it is over. For queries whose result is stored."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def filesystem(path: str):
    """The pyarrow file system of a path or URI, and the path in it."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        if path.startswith("file:") and not path.startswith("file:///"):
            path = "file://" + path[len("file:") :]
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def file_bytes(path: str) -> bytes:
    """A file that the driver can read; vocabularies are small and of fixed size."""
    with open(path, "rb") as f:
        return f.read()
