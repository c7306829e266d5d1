"""Results that must outlive an executor are written to the cluster's shared folder."""

from __future__ import annotations

import contextvars
import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_RUN: contextvars.ContextVar[Scratch | None] = contextvars.ContextVar("run", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local master falls back to a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spectral-topics-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back: cuts lineage and survives the loss of executors.

    Inside a ``Scratch`` the table belongs to the run: one that an earlier attempt finished is read, not computed.
    """
    run = _RUN.get()
    path = scratch_path(df.sparkSession, label) if run is None else run.next_path(label)
    if run is None or not run.finished(path):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """The stored tables of one run, in a folder of its own below the shared folder.

    ``with Scratch(spark, "name"): ...`` numbers the tables that the block stores. When the block ends they are
    deleted, so what it returns must be written or collected inside. When it raises, or the driver is lost, they stay:
    the same block under the same name goes on after the last table that was finished (Spark's ``_SUCCESS`` marker).
    Without a name the run has one of its own and can't be continued. The block has to store the same tables in the same order each time.
    """

    def __init__(self, spark: SparkSession, name: str | None = None):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/run-{name or uuid.uuid4().hex}"
        self.stored = self.reused = 0
        self._token = None

    def __enter__(self) -> Scratch:
        if _RUN.get() is not None:
            raise RuntimeError("a run is open already")
        self.stored = self.reused = 0
        self._token = _RUN.set(self)
        return self

    def __exit__(self, kind, *_) -> None:
        _RUN.reset(self._token)
        if kind is None:
            path, files = self._at(self.folder)
            files.delete(path, True)

    def next_path(self, label: str) -> str:
        self.stored += 1
        return f"{self.folder}/{self.stored:04d}-{label}"

    def finished(self, path: str) -> bool:
        marker, files = self._at(f"{path}/_SUCCESS")
        found = files.exists(marker)
        self.reused += found
        return found

    def expect(self, settings: dict) -> None:
        """Note what the run's tables depend on; a run that began with other settings is not continued."""
        path, text = f"{self.folder}/settings", json.dumps(settings, sort_keys=True)
        marker, files = self._at(f"{path}/_SUCCESS")
        if files.exists(marker):
            before = self.spark.read.text(path).first()[0]
            if before != text:
                raise ValueError(f"{self.folder} holds tables of a run with other settings or data: {before}, now {text}")
            return
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)

    def _at(self, name: str):
        """A path and its file system, by Hadoop's API: whatever Spark can write to."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())


def current_run() -> Scratch | None:
    return _RUN.get()
