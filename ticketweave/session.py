"""Session helpers: a local session for tests and bench, and the shared work folder."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, memory: str = "16g") -> SparkSession:
    """A ``local[n]`` session for tests and bench; cluster jobs bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("ticketweave")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


@functools.cache
def _own_folder(application: str) -> str:
    """One temporary folder for each local application, removed when the process ends."""
    folder = tempfile.mkdtemp(prefix="ticketweave-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, taken from ``spark.checkpoint.dir``.

    Only a ``local[...]`` session without that setting gets a folder of its own;
    the session's settings are left alone.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return _own_folder(spark.sparkContext.applicationId)


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared folder and read it back.

    Used where a costly result is read more than once: the lineage is cut and
    the rows outlive any executor.
    """
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Lets Spark delete a job's shuffle files as soon as the job is over.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    """A session setting that holds within the block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


# Folders of the workspaces made within each open ``temporary_tables`` block.
_BLOCKS: list[list[str]] = []


@contextmanager
def temporary_tables(spark: SparkSession):
    """Delete the tables of every workspace made within the block when it ends.

    For jobs that write their result before the block ends: nothing lazy that
    came out of it can be read afterwards.
    """
    _BLOCKS.append([])
    try:
        yield
    finally:
        for folder in _BLOCKS.pop():
            _delete(spark, folder)


class Workspace:
    """The intermediate tables of one job in the shared folder.

    ``write`` stores a result that is read more than once, which cuts its
    lineage and lets its rows outlive any executor; ``drop`` deletes what later
    steps no longer read. Used as a context manager it drops everything at the
    end, so only a job that returns nothing lazy may use it that way.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = work_path(spark, name)
        self._paths: dict[str, str] = {}
        if _BLOCKS:
            _BLOCKS[-1].append(self.root)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as a Parquet table of this name, replacing an earlier one, and read it."""
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        with _setting(self.spark, SHUFFLE_CLEANUP, "true"):
            df.write.parquet(path)
        self.drop(name)
        self._paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if path := self._paths.pop(name, None):
                _delete(self.spark, path)

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        self._paths.clear()
        _delete(self.spark, self.root)


def _delete(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever file system holds it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
