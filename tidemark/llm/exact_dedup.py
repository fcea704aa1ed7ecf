"""Exact deduplication as a stateful stream over fingerprints.

A first pass turns each text into a narrow fingerprint row: digest, length, id, and the file and
row in it that the text is found at. A Structured Streaming aggregation then keeps, per digest and
without expiry, the row that stays in RocksDB state; running it again on the same checkpoint with
more rows continues from that state. Texts whose digest was hit are found again by file and row
and compared byte for byte with the one that stays, so a digest collision cannot merge different
texts; a group of many copies is dealt out, with a copy of the text that stays to ``DEAL`` hits each.
Only DataFrame functions are used.

Defined cases: a null text counts as empty; rows without an id rank after all others; of
repeated rows exactly one is kept; an empty table gives an empty result; other columns of
the input play no part, whatever their names. Input that is no plain read of a Parquet table is stored first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import placed, readable_rows, scratch, settings, small, stored

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Hits that one copy of the text that stays is compared with, about.
DEAL = 1000
#: Deleted before texts are compared (fixed values): space, tab, newline, vertical tab, form feed, carriage return.
DELETED = [" ", "\t", "\n", "\u000b", "\f", "\r"]


def squeezed(text: Column) -> Column:
    """The text without white space; null as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in DELETED:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def sha256(normal: Column) -> Column:
    return F.sha2(normal, 256)


def located(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text, file, row: every text with where it is found."""
    return placed(readable_rows(docs, [F.col(id_col).alias("id"), F.col(text_col).alias("text")]))


def fingerprints(texts: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One narrow row per located text: id, digest, points (code points), file, row."""
    return texts.select("id", digest(squeezed(F.col("text"))).alias("digest"), F.coalesce(F.length("text"), F.lit(0)).alias("points"), "file", "row")


def _best() -> Column:
    """The row that stays is the least of these: the longest text, a row with an id, the smallest id, the first place."""
    return F.struct((-F.col("points")).alias("points_down"), F.col("id").isNull().alias("unidentified"), "id", "file", "row")


def keyed_state(spark: SparkSession, table: str, checkpoint: str, max_files: int | None = None) -> DataFrame:
    """Runs the fingerprints in a folder through the stream; returns the state, a row per digest.

    Columns: digest, keep (points_down, unidentified, id, file, row), group_size. Files that
    an earlier run on this checkpoint has read are not read again; state never expires.
    """
    schema = spark.read.parquet(table).schema
    source = spark.readStream.schema(schema)
    if max_files:
        source = source.option("maxFilesPerTrigger", max_files)
    state = source.parquet(table).groupBy("digest").agg(F.min(_best()).alias("keep"), F.count("*").alias("group_size"))
    # Without fallocate a store of few keys takes few bytes of disk, and closed with its task it holds no memory outside the heap,
    # however many partitions there are.
    with settings(spark, spark__sql__streaming__stateStore__providerClass=ROCKSDB, spark__sql__streaming__stateStore__rocksdb__allowFAllocate="false", spark__sql__streaming__stateStore__unloadOnCommit="true"):
        run = state.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        run.awaitTermination()
        held = spark.read.format("statestore").load(checkpoint)
        keep, size = (f"value.`{f.name}`" for f in held.schema["value"].dataType.fields)
        return held.select("key.digest", F.col(keep).alias("keep"), F.col(size).alias("group_size"))


def collisions(texts: DataFrame, members: DataFrame) -> DataFrame:
    """Digests of which two texts differ: full bytes of each hit against the row that stays."""
    here = F.col("kept")
    deals = F.ceil(F.col("group_size") / DEAL).cast("int")
    hits = members.where("group_size > 1").select("file", "row", "digest", "kept", deals.alias("deals"), F.pmod(F.xxhash64("file", "row"), deals).cast("int").alias("deal"))
    hits = stored(hits, "dedup-hits")
    full = texts.join(small(hits), ["file", "row"]).select("digest", "kept", "deals", "deal", squeezed(F.col("text")).alias("normal"))
    first = full.where(here).select("digest", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"), F.col("normal").alias("first"))
    return full.where(~here).join(first, ["digest", "deal"]).where("normal <> first").select("digest").distinct()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, max_files: int | None = None) -> DataFrame:
    """One row per row of docs: id, digest, keep_id, group_size, kept, and file and row where it is found.

    Of texts equal without white space, the longest (in code points of the original), then the
    smallest id, stays.
    """
    spark = docs.sparkSession
    texts = located(docs, id_col, text_col)
    table = scratch(spark, "dedup-fingerprints")
    fingerprints(texts, digest).write.parquet(table)
    prints = spark.read.parquet(table)
    state = stored(keyed_state(spark, table, scratch(spark, "dedup-state"), max_files), "dedup-groups")
    kept = (F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))
    members = prints.join(state, "digest").withColumn("kept", kept)
    bad = stored(collisions(texts, members), "dedup-collisions")
    out = members.select("id", "digest", F.col("keep.id").alias("keep_id"), "group_size", "kept", "file", "row")
    if bad.isEmpty():
        return out
    return out.join(bad, "digest", "left_anti").unionByName(_by_bytes(texts, bad, digest))


def _by_bytes(texts: DataFrame, bad: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """The rows of colliding digests, grouped by their bytes instead."""
    normal = squeezed(F.col("text"))
    rows = texts.select("id", F.coalesce(F.length("text"), F.lit(0)).alias("points"), normal.alias("normal"), digest(normal).alias("digest"), "file", "row").join(bad, "digest", "left_semi")
    groups = rows.groupBy("digest", "normal").agg(F.min(_best()).alias("keep"), F.count("*").alias("group_size"))
    kept = (F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))
    return rows.join(groups, ["digest", "normal"]).select("id", "digest", F.col("keep.id").alias("keep_id"), "group_size", kept.alias("kept"), rows["file"], rows["row"])
