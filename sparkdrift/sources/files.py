"""Path checks and removal through the file system Spark itself uses."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file_system(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a directory; False when it was not there."""
    fs, p = _file_system(spark, path)
    return fs.exists(p) and fs.delete(p, True)


def shared_folder(spark: SparkSession, purpose: str = "data") -> str:
    """The path of a fresh folder that driver and executors share, not created yet.

    It lies in ``spark.checkpoint.dir``. Only a local session, where driver and executors are one process,
    may do without that setting; it gets a temporary folder, which is set for the whole session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="sparkdrift-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


#: Folders written inside open ``temporary_tables`` blocks, innermost last.
_open_blocks: list[list[str]] = []


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Remove what ``written`` leaves in the shared folder inside the block when the block ends.

    For callers whose results are collected, written or no longer needed by then: frames built inside can't
    be read afterwards.
    """
    mine: list[str] = []
    _open_blocks.append(mine)
    try:
        yield
    finally:
        _open_blocks.remove(mine)
        for path in mine:
            remove(spark, path)


def written(df: DataFrame) -> DataFrame:
    """The frame written to the shared folder and read again: its rows are fixed and its lineage ends.

    The folder stays, unless an enclosing ``temporary_tables`` block removes it.
    """
    path = shared_folder(df.sparkSession)
    if _open_blocks:
        _open_blocks[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(df: DataFrame) -> Iterator[DataFrame]:
    """As ``written``, for readers that end inside the block: the folder is removed after it."""
    path = shared_folder(df.sparkSession, "scratch")
    try:
        df.write.parquet(path)
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        remove(df.sparkSession, path)


def write_once(spark: SparkSession, path: str, text: str) -> bool:
    """Publish a small text file by one rename; False when a file of that name is there already."""
    fs, target = _file_system(spark, path)
    draft = spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), f".draft-{uuid.uuid4().hex}")
    out = fs.create(draft)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    kind = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.NONE
    try:
        context.rename(draft, target, options)
        return True
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" in error.java_exception.toString():
            return False
        raise
    finally:
        fs.delete(draft, False)


def read_text(spark: SparkSession, path: str) -> str:
    """The content of a small text file."""
    fs, target = _file_system(spark, path)
    opened = fs.open(target)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(opened)).decode()
    finally:
        opened.close()


def names(spark: SparkSession, path: str) -> list[str]:
    """What a directory holds, in order; nothing when it is not there."""
    fs, target = _file_system(spark, path)
    return sorted(status.getPath().getName() for status in fs.listStatus(target)) if fs.exists(target) else []
