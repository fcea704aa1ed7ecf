"""Token ids in ORC: range-sorted by document id, written once, read back in parallel.

Each file holds an ascending range of ids. ORC stores the id lists as run-length encoded
integers in stripes with row indexes, and keeps min, max and a Bloom filter of the document
id, so a reader can skip stripes for an id predicate. Texts (not ids) go through the one
shuffle that sorts them.

Defined cases: a null text is empty and holds just the end id; a null id comes first; rows
with the same id are ordered by their text; an empty table writes an empty store; other
columns are not stored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .textops import slices
from .workspace import small_batches, stored

#: Bytes of text that are encoded at once, about.
SLICE = 1 << 20
STORE_SCHEMA = "doc_id long, shard int, row long, ids array<int>"


def _stored_rows(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import encoder

        encode = encoder(path)
        shard, row = TaskContext.get().partitionId(), 0
        for batch in slices(batches, "text", SLICE):
            off, ids = encode.batch(batch.column("text"), end_id)
            lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids.view(np.int32)))
            n = batch.num_rows
            yield pa.record_batch([batch.column("doc_id"), pa.array(np.full(n, shard), pa.int32()), pa.array(np.arange(row, row + n)), lists], ["doc_id", "shard", "row", "ids"])
            row += n

    return run


def write_tokens(docs: DataFrame, out: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> None:
    """Writes (doc_id, shard, row, ids) as ORC, ascending in doc_id over files and within them.

    shards: how many files, else as many as the session's shuffle has partitions (or fewer, as
    adaptive execution joins small ones).
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    small_batches(docs.sparkSession)
    # Texts split an id that many rows have, as a null one.
    ordered = rows.repartitionByRange(*([shards] if shards else []), "doc_id", F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    tokens = ordered.mapInArrow(_stored_rows(tokenizer, end_id), STORE_SCHEMA)
    tokens.write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.row.index.stride", "10000").orc(out)


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        off = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1] if len(ids) else np.zeros(1, np.int32)
        held = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        sums = [zlib.crc32(held[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)]
        names = ["doc_id", "shard", "row"]
        yield pa.record_batch([*(batch.column(n) for n in names), pa.array(np.diff(off), pa.int64()), pa.array(sums, pa.int64())], [*names, "n_tokens", "ids_crc32"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The store's rows; filters on doc_id reach the files' statistics and Bloom filters."""
    return spark.read.schema(STORE_SCHEMA).orc(path)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a store: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    rows = read_tokens(spark, path).mapInArrow(_checked, "doc_id long, shard int, row long, n_tokens long, ids_crc32 long")
    rows = stored(rows, "token-index")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    inside = Window.partitionBy("shard").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("shard_start") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    return rows.join(shards, "shard").select("doc_id", start.cast("long").alias("start"), "n_tokens", "ids_crc32")
