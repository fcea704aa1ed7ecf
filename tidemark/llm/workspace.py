"""Shared scratch tables, and broadcasts behind a size check."""

from __future__ import annotations

import ctypes
import gc
import re
import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of one side that a join may broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 400_000


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir`` (set here only where unset, as in tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tidemark/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once to a shared Parquet table and read back: cuts the lineage.

    The shuffle files of that one query go when it ends, and not when the driver happens to collect garbage.
    """
    path = scratch(df.sparkSession, name)
    with settings(df.sparkSession, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the table of a stored DataFrame, which no plan may read any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def tidy(spark: SparkSession) -> None:
    """Has the driver collect garbage, so that Spark deletes the shuffle files of plans that are gone before more are written."""
    gc.collect()
    spark._jvm.System.gc()


def _read_once(docs: DataFrame) -> bool:
    """Whether docs is a plain read of files that know their rows' numbers, each of them once: by its plan, whose folders and not whose files are looked at."""
    plan = docs._jdf.queryExecution().analyzed()
    steps = set(re.findall(r"^[\s:+-]*(\w+)", plan.toString(), re.M))
    # Other steps may make several rows of one.
    if not steps <= {"Project", "Filter", "SubqueryAlias", "Relation"} or "_metadata" in docs.columns:
        return False
    try:
        docs.select("_metadata.row_index")
        roots = plan.collectLeaves().head().relation().location().rootPaths()
        paths = sorted(roots.apply(i).toString().rstrip("/") + "/" for i in range(roots.size()))
    except Exception:  # noqa: BLE001  another format, or no files at all
        return False
    return all(not b.startswith(a) for a, b in zip(paths, paths[1:], strict=False))


def readable_rows(docs: DataFrame, columns: list[Column]) -> DataFrame:
    """columns of docs, as a plain read of a Parquet table (``placed`` can say where its rows are); stored, if docs is none."""
    rows = docs.select(*columns)
    return rows if _read_once(docs) else stored(rows, "rows")


def placed(rows: DataFrame) -> DataFrame:
    """Readable rows with the file and the row in it where they are found, which a retry finds again."""
    return rows.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def file_numbers(rows: DataFrame) -> DataFrame:
    """(file, file_no) of the files of placed rows."""
    return stored(rows.select("file").distinct().withColumn("file_no", F.row_number().over(Window.orderBy("file"))), "files")


def numbered(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Placed rows with row_no, a number of their own."""
    return rows.join(small(files), "file").withColumn("row_no", F.shiftleft(F.col("file_no").cast("long"), 40) + F.col("row")).drop("file_no")


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """Bounds the bytes of an Arrow batch that goes to a Python task, unless the session already does."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) in (None, str((1 << 31) - 1)):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most that many rows, else as it is.

    df should be a stored table of narrow rows, so that counting it is cheap.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def lean(keep_tokenizer: bool = False) -> None:
    """For the start and end of a Python task: the worker, which Spark uses again, lets go of freed memory, tables of powers and another operator's tokenizer."""
    tokens, textops = sys.modules.get("tidemark.llm.tokens"), sys.modules.get("tidemark.llm.textops")
    if textops:
        textops.held_powers.cache_clear()
    if tokens and tokens.LOADED and not keep_tokenizer:
        tokens.LOADED.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # where the C library can give freed pages back
        ctypes.CDLL(None).malloc_trim(0)


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (dots written as double underscores) for a block of code."""
    keys = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
