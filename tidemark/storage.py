"""Folders and small files in the storage that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir`` (set here only where unset, as in tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tidemark/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once to a shared Parquet table and read back: cuts the lineage."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def located(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def get_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file; None where there is none."""
    fs, at = located(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Puts a small file in place whole: written beside it, then renamed."""
    fs, at = located(spark, path)
    part = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.part-{uuid.uuid4().hex}")
    stream = fs.create(part, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if not fs.rename(part, at):
        fs.delete(at, False)
        if not fs.rename(part, at):
            raise OSError(f"{path} could not be written")


def delete(spark: SparkSession, path: str) -> None:
    fs, at = located(spark, path)
    fs.delete(at, True)


def files(spark: SparkSession, path: str) -> dict[str, int]:
    """Sizes of all data files below a folder, by path; files whose names begin with . or _ are left out."""
    fs, at = located(spark, path)
    out, found = {}, fs.listFiles(at, True) if fs.exists(at) else None
    while found is not None and found.hasNext():
        f = found.next()
        if f.getPath().getName()[0] not in "._":
            out[f.getPath().toString()] = f.getLen()
    return out


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for a block of code."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
