"""Tables that are made once and read again, and files in shared folders."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir; a session without one, as in tests, gets one of its own."""
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if not known.isDefined():
        named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="figlake-checkpoint-"))
        known = context._jsc.sc().getCheckpointDir()
    return known.get()


def materialised(df: DataFrame) -> DataFrame:
    """The rows of df, computed now and kept in a reliable checkpoint, so that what made them runs once however often they are read."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def made(spark: SparkSession, folder: str) -> str:
    """The folder, which is there now even if nothing gets written to it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    return folder


def delete(spark: SparkSession, folder: str) -> None:
    """Deletes a folder with what is in it, in whatever store it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def opened(target: str) -> tuple[Any, str]:
    """(Arrow file system, path in it) of a folder or URI."""
    from pyarrow import fs

    if target.startswith("file:"):
        return fs.LocalFileSystem(), "/" + target[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(target) if "://" in target else (fs.LocalFileSystem(), target)


def put(store: Any, path: str, data: bytes) -> None:
    """Writes a file in one go; the folder is made if need be."""
    with contextlib.suppress(OSError):
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(path) as f:
        f.write(data)
