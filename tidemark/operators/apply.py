"""Applying batches to tables: append, overwrite, upsert, merge, history, and their sync modes.

Operators return the new table as a plan; ``replace`` puts it in the place of a stored one.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import storage
from . import schemas

#: Sync modes and the shorter names they also go by (fixed values).
MODES = {"full_refresh_overwrite", "full_refresh_append", "incremental_append", "incremental_append_deduped", "cdc_incremental_deduped_history"}
#: Write modes (fixed values).
WRITES = {"append", "replace", "upsert", "merge"}
ALIASES = {"full_refresh": "full_refresh_overwrite", "incremental": "incremental_append_deduped", "cdc": "cdc_incremental_deduped_history"}


def append(table: DataFrame, batch: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """All rows of both; with keys, rows that the batch brings again replace the old ones."""
    old = table.join(batch.select(*keys).distinct(), keys, "left_anti") if keys else table
    return old.unionByName(batch, allowMissingColumns=True)


def upsert(table: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the batch (one a key) replace or join those of the table; without keys it appends."""
    return append(table, batch, keys or None).select(*table.columns)


def delete(table: DataFrame, keys_gone: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(keys_gone.select(*keys), keys, "left_anti").select(*table.columns) if keys else table


def scd1(table: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """Compacted events (op, table columns): c, u, r upsert, d deletes."""
    rest = table.join(events.select(*keys), keys, "left_anti")
    return rest.select(*table.columns).unionByName(events.where("op <> 'd'").select(*table.columns))


def merge(table: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """Compacted events: u changes and d removes a present row, c adds a missing one; all else is ignored."""
    values = [c for c in table.columns if c not in keys]
    t = table.select(*keys, F.struct(F.lit(1).alias("__there"), *values).alias("__old"))
    e = events.select(*keys, "op", F.struct(F.lit(1).alias("__there"), *values).alias("__new"))
    both = t.join(e, keys, "full_outer")
    there, op = F.col("__old").isNotNull(), F.coalesce("op", F.lit(""))
    keep = F.when(there, op != "d").otherwise(op == "c")
    row = F.when(there & (op != "u"), F.col("__old")).otherwise(F.col("__new"))
    return both.where(keep).select(*keys, row.alias("__row")).select(*keys, *[F.col(f"__row.{c}").alias(c) for c in values]).select(*table.columns)


def scd2(history: DataFrame, events: DataFrame, keys: list[str], at: str = "valid_from", order: list[str] | None = None) -> DataFrame:
    """history (columns, valid_from, valid_to, is_deleted) with events (columns, op, valid_from): every change closes the row before it.

    A delete closes and marks the row and adds none. Validity is event time: a late event cuts the
    row that was valid then, closed or open, and is valid up to that row's end. Rows of no
    duration stay as they are.
    """
    columns = [c for c in history.columns if c not in ("valid_from", "valid_to", "is_deleted")]
    tie = order or [at]
    no_tie = [F.lit(None).cast(events.schema[c].dataType).alias(f"__{c}") for c in tie]
    item = lambda df, since, op, rank, ties: df.select(*columns, since.alias("valid_from"), op.alias("op"), F.lit(rank).alias("__rank"), *ties)
    lasting = history.where("valid_to IS NULL OR valid_to > valid_from")
    # Ends of closed rows stand in the chain as deletes, or as gaps if nothing was deleted.
    ends = item(lasting.where("valid_to IS NOT NULL"), F.col("valid_to"), F.when(F.col("is_deleted"), "d").otherwise("gap"), 0, no_tie)
    chain = item(lasting, F.col("valid_from"), F.lit("r"), 1, no_tie).unionByName(ends)
    chain = chain.unionByName(item(events, F.col("valid_from"), F.col("op"), 1, [F.col(c).alias(f"__{c}") for c in tie]))
    following = Window.partitionBy(*keys).orderBy("valid_from", "__rank", *(F.col(f"__{c}").asc_nulls_first() for c in tie))
    closed = chain.withColumns({"valid_to": F.lead("valid_from").over(following), "is_deleted": F.coalesce(F.lead("op").over(following) == "d", F.lit(False))})
    out = closed.where("op NOT IN ('d', 'gap')").select(*columns, "valid_from", "valid_to", "is_deleted")
    return out.unionByName(history.where("valid_to <= valid_from").select(*out.columns))


def empty(mode: str, batch: DataFrame) -> DataFrame:
    """The table that a mode's first batch meets."""
    if mode == "cdc_incremental_deduped_history":
        batch = batch.drop("op").withColumns({"valid_to": F.lit(None).cast("timestamp"), "is_deleted": F.lit(False)})
    return batch.where("false")


def newest(batch: DataFrame, keys: list[str], order: list[str] | str | None = None) -> DataFrame:
    """One row a key: the last by order. Where rows tie, or without an order, the row that the batch's plan brings last."""
    order = [order] if isinstance(order, str) else order or []
    rest = [c for c in batch.columns if c not in keys]
    arrived = batch.withColumn("__arrived", F.monotonically_increasing_id())
    rank = F.struct(*order, "__arrived")
    return arrived.groupBy(*keys).agg(F.max_by(F.struct(*rest) if rest else F.lit(0), rank).alias("__row")).select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*batch.columns)


def coerced(table: DataFrame, batch: DataFrame, keys: list[str], tries: int = 3) -> tuple[DataFrame, DataFrame]:
    """table and batch of one schema: the batch in the table's types, where its values fit them; a column with a value that does not is text in both.

    A key never changes its type: a key value that does not fit raises, and so does what still does not fit after tries.
    """
    shared = [c for c in table.columns if c in batch.columns]
    for _ in range(tries):
        kinds = dict(table.dtypes)
        misfit = [F.bool_or(F.col(c).isNotNull() & F.col(c).try_cast(kinds[c]).isNull()).alias(c) for c in shared if kinds[c] != "string" and dict(batch.dtypes)[c] != kinds[c]]
        bad = [c for c, v in (batch.agg(*misfit).first().asDict() if misfit else {}).items() if v]
        if not bad:
            return table, batch.withColumns({c: F.col(c).cast(kinds[c]) for c in shared if dict(batch.dtypes)[c] != kinds[c]})
        if held := [c for c in bad if c in keys]:
            raise ValueError(f"values of the keys {held} do not fit the table")
        table = table.withColumns({c: F.col(c).cast("string") for c in bad})
        batch = batch.withColumns({c: F.col(c).cast("string") for c in bad})
    raise ValueError(f"{bad} still do not fit after {tries} tries")


def sync(mode: str, table: DataFrame | None, batch: DataFrame, keys: list[str] | None = None, cursor: str | None = None, loaded_at: Column | None = None, order: list[str] | None = None) -> DataFrame:
    """The table after a batch under one of MODES (or an alias of one); without a table, after its first batch.

    Of rows of one key (for history: of one key and instant) the last stays, by cursor and by order, the columns that
    number changes; where these tie, the one that the batch brings last.
    """
    mode = ALIASES.get(mode.lower(), mode.lower())
    if mode not in MODES:
        raise ValueError(f"unknown sync mode {mode!r}")
    if mode == "full_refresh_overwrite":
        return batch
    table = empty(mode, batch) if table is None else table
    if mode == "full_refresh_append":
        return table.unionByName(batch.withColumn("loaded_at", loaded_at if loaded_at is not None else F.current_timestamp()), allowMissingColumns=True)
    if mode == "incremental_append":
        return table.unionByName(batch, allowMissingColumns=True)
    if not keys or set(keys) - set(batch.columns):
        raise ValueError(f"{mode} needs its keys in the batch")
    if mode == "cdc_incremental_deduped_history":
        known = batch if order is None else batch.drop(*[c for c in order if c not in (*table.columns, "op", "valid_from")])
        return scd2(table, newest(batch, [*keys, "valid_from"], order).select(*known.columns), keys)
    return upsert(table, newest(batch, keys, [*([cursor] if cursor else []), *(order or [])]), keys)


def write(mode: str, table: DataFrame | None, batch: DataFrame, keys: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """The table after a batch under one of WRITES; merge takes compacted events with an op, the others take rows.

    Of rows of one key, upsert takes the last by order, or the one that the batch brings last.
    """
    if mode not in WRITES:
        raise ValueError(f"unknown write mode {mode!r}")
    if mode == "replace":
        return batch
    table = (batch.drop("op") if mode == "merge" else batch).where("false") if table is None else table
    if mode == "append":
        return table.unionByName(batch, allowMissingColumns=True)
    if not keys:
        raise ValueError(f"{mode} needs keys")
    return upsert(table, newest(batch, keys, order), keys) if mode == "upsert" else scd1(table, batch, keys)


def since(df: DataFrame, cursor: str, mark) -> DataFrame:
    """Rows at or after a high-water mark; the filter reaches the scan."""
    return df if mark is None else df.where(F.col(cursor) >= F.lit(mark))


def high_water(df: DataFrame, cursor: str) -> str | None:
    return df.agg(F.max(cursor).cast("string").alias("m")).first()["m"]


def replace(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Writes df beside path, then renames it into place.

    Between two renames there is no table at path for a moment. If the second one fails, the
    old table is put back; it is deleted only after the new one is in place.
    """
    spark: SparkSession = df.sparkSession
    temp, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.partitionBy(*(partition_by or [])).parquet(temp)
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    swap(fs, at(temp), at(path), at(old))


def publish_version(df: DataFrame, path: str, partition_by: list[str] | None = None, keep: int = 2) -> str:
    """Full refresh without a moment in between: df becomes a version of its own below path, and a small file names it as the current one.

    Readers that resolved the version before go on with it; the last keep versions stay. Returns the version's folder.
    """
    spark = df.sparkSession
    name = f"v-{time.time_ns():020}-{uuid.uuid4().hex[:8]}"
    df.write.partitionBy(*(partition_by or [])).parquet(f"{path}/{name}")
    storage.put_text(spark, f"{path}/_current", name)
    fs, at = storage.located(spark, path)
    versions = sorted(f.getPath().getName() for f in fs.listStatus(at) if f.getPath().getName().startswith("v-"))
    for old in [v for v in versions if v < name][: max(0, len(versions) - keep)]:
        storage.delete(spark, f"{path}/{old}")
    return f"{path}/{name}"


def current(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a table that ``publish_version`` writes."""
    name = storage.get_text(spark, f"{path}/_current")
    if name is None:
        raise FileNotFoundError(f"{path} has no version yet")
    return spark.read.parquet(f"{path}/{name}")


def evolved(table: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame, list]:
    """table and batch in the schema that holds both, and the changes that a stored table needs for it."""
    schema, changes = schemas.evolve(table.schema, batch.schema)
    return schemas.reconcile(table, schema), schemas.reconcile(batch, schema), changes


def swap(fs, temp, target, old) -> None:
    """Puts the folder temp in the place of target by renames, whose results are looked at."""
    held = fs.exists(target)
    if held and not fs.rename(target, old):
        fs.delete(temp, True)
        raise OSError(f"{target} could not be set aside and stays as it was")
    if not fs.rename(temp, target):
        back = not held or fs.rename(old, target)
        raise OSError(f"{temp} could not take the place of {target}; the old table is {'back' if back else f'at {old}'}")
    if held:
        fs.delete(old, True)


def bins(sizes: dict[str, int], target: int) -> list[list[str]]:
    """Files below three quarters of target, packed into bins of about target, each bin from one folder: two files or more each."""
    small, out = {}, []
    for path, size in sorted(sizes.items()):
        if size < target * 3 // 4:
            small.setdefault(path.rpartition("/")[0], []).append((size, path))
    for found in small.values():
        free: list[list] = []  # room left, files
        for size, path in sorted(found, reverse=True):
            place = next((b for b in free if b[0] >= size), None)  # first fit, the largest first
            if place is None:
                free.append(place := [target, []])
            place[0] -= size
            place[1].append(path)
        out += [paths for _, paths in free if len(paths) > 1]
    return out


def compact(spark: SparkSession, path: str, target_bytes: int = 128 << 20) -> dict[str, int]:
    """Rewrites the small Parquet files of a table, folder by folder, to about target_bytes each; large files and folders stay.

    Only file names and sizes pass through the driver. A task writes one bin's files as one. What replaces what is
    first written to a journal beside the data, which ``finish_compaction`` carries on after a crash; for a
    moment a reader may miss a bin's rows, as there is no table format. Returns files before, after and rewritten.
    """
    finish_compaction(spark, path)
    sizes = storage.files(spark, path)
    packed = bins(sizes, target_bytes)
    if not packed:
        return {"before": len(sizes), "after": len(sizes), "rewritten": 0}
    work = f"{path}/_compact-{uuid.uuid4().hex}"
    of = spark.createDataFrame([(f, i) for i, paths in enumerate(packed) for f in paths], "file string, bin int")
    rows = spark.read.parquet(*[f for paths in packed for f in paths]).select("*", F.col("_metadata.file_path").alias("__file"))
    name = lambda c: F.regexp_replace(c, "^[a-z]+:/+", "/")
    met = rows.join(of.withColumnRenamed("bin", "__bin"), name(F.col("__file")) == name(F.col("file"))).drop("__file", "file")
    met.repartition(len(packed), "__bin").write.partitionBy("__bin").parquet(f"{work}/rows")
    held = storage.files(spark, f"{work}/rows")
    moves = []
    for i, paths in enumerate(packed):
        new = [f for f in held if f"/__bin={i}/" in f]
        folder = paths[0].rpartition("/")[0]
        moves.append({"old": paths, "new": [[f, f"{folder}/compacted-{uuid.uuid4().hex}.parquet"] for f in new]})
    storage.put_text(spark, f"{path}/_compaction.json", json.dumps({"work": work, "moves": moves}))
    finish_compaction(spark, path)
    return {"before": len(sizes), "after": len(storage.files(spark, path)), "rewritten": sum(map(len, packed))}


def finish_compaction(spark: SparkSession, path: str) -> bool:
    """Carries out the moves of a compaction's journal, if there is one: old files go, new ones take their place. May be repeated."""
    journal = f"{path}/_compaction.json"
    if not (held := storage.get_text(spark, journal)):
        return False
    plan = json.loads(held)
    for move in plan["moves"]:
        for old in move["old"]:
            storage.delete(spark, old)
        for new, to in move["new"]:
            fs, at = storage.located(spark, new)
            target = storage.located(spark, to)[1]
            if fs.exists(at) and not fs.rename(at, target):
                raise OSError(f"{new} could not be moved to {to}")
    storage.delete(spark, journal)
    storage.delete(spark, plan["work"])
    return True


def overwrite_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replaces only those partitions of a stored table that df has rows for; the files of all others stay as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def touched(spark: SparkSession, path: str, by: str, values: list) -> DataFrame:
    """A stored table's rows in some of its partitions: only their files are read."""
    return spark.read.parquet(path).where(F.col(by).isin(values))


def bucketed(df: DataFrame, table: str, keys: list[str], buckets: int = 64, mode: str = "overwrite") -> DataFrame:
    """Writes or appends to a table that is bucketed and sorted by its keys: joins and groups by them exchange only the other side."""
    df.write.mode(mode).bucketBy(buckets, *keys).sortBy(*keys).format("parquet").saveAsTable(table)
    return df.sparkSession.table(table)


def record(entries: DataFrame, path: str, at: str = "created_at") -> None:
    """Appends entries to a stored audit table, which is partitioned by their day."""
    entries.withColumn("day", F.to_date(at)).write.mode("append").partitionBy("day").parquet(path)


def audit(table: DataFrame | None, entries: DataFrame, at: str = "created_at") -> DataFrame:
    """An audit table with new entries, with the day that it is partitioned by (replace(..., partition_by=["day"]))."""
    entries = entries.withColumn("day", F.to_date(at))
    return entries if table is None else table.unionByName(entries, allowMissingColumns=True)


def partition_columns(specs: list[dict], df: DataFrame | None = None) -> dict[str, Column]:
    """Derived partition columns: identity, year, month, day, hour, bucket(n), truncate(n).

    truncate keeps the first n characters of text and rounds whole numbers down to a multiple
    of n; which of them a column is says df, without which all are text.
    """
    kinds = dict(df.dtypes) if df is not None else {}
    out = {}
    for s in specs:
        kind, name = s.get("transform", "identity"), s["column"]
        c, n = F.col(name), int(s.get("n", 16))
        formats = {"year": "yyyy", "month": "yyyy-MM", "day": "yyyy-MM-dd", "hour": "yyyy-MM-dd-HH"}
        if kind in formats:
            out[f"{name}_{kind}"] = F.date_format(c, formats[kind])
        elif kind == "bucket":
            out[f"{name}_bucket"] = F.pmod(F.hash(c), F.lit(n))
        elif kind == "truncate":
            whole = kinds.get(name, "string") in ("tinyint", "smallint", "int", "bigint") or kinds.get(name, "").startswith("decimal")
            out[f"{name}_trunc"] = c - F.pmod(c, F.lit(n)) if whole else F.substring(c.cast("string"), 1, n)
        elif kind == "identity":
            out[name] = c
        else:
            raise ValueError(f"unknown partition transform {kind!r}")
    return out
