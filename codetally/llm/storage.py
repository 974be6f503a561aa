"""Intermediate tables and files in the folder that all executors share."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from codetally.sources.checkpoints import ensure_checkpoint_dir


# The folder of each session, by application.
_FOLDERS: dict[str, str] = {}


def session_folder(spark: SparkSession) -> str:
    """A folder of this session in the shared folder; it is deleted when the driver ends."""
    application = spark.sparkContext.applicationId
    if application not in _FOLDERS:
        folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{application}-{uuid.uuid4().hex}"
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
        system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(hadoop)
        system.deleteOnExit(hadoop)
        _FOLDERS[application] = folder
    return _FOLDERS[application]


def new_path(spark: SparkSession, kind: str) -> str:
    """A path in the folder of the session that nothing has used."""
    return f"{session_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def stage(df: DataFrame, kind: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it from there.

    Cuts the lineage; unlike a local checkpoint the rows survive the executors.
    """
    spark = df.sparkSession
    path = new_path(spark, kind)
    df.write.parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged._staged_path = path
    return staged


def drop_staged(*frames: DataFrame) -> None:
    """Delete tables written by :func:`stage` that nothing reads any more."""
    for frame in frames:
        path = getattr(frame, "_staged_path", None)
        if path:
            remove(frame.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def release() -> None:
    """Give freed memory back to the system: Python workers live on between tasks, several beside one executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # GNU only
    if trim:
        trim(0)


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path in the shared folder, and the path within it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path
