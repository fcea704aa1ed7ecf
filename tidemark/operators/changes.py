"""Change events: envelope, identity, decoding, compaction, routing, tombstones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENVELOPE = "event_id string, op string, source_id string, bank_id string, tenant_id string, schema_name string, table_name string, lsn string, ts_ms bigint, pk_values string, before string, after string, metadata string, processed_at bigint"


def event_id(pk_json: Column, lsn: Column) -> Column:
    """Digest of the key and position as sorted JSON text with spaced separators; pk_json is spaced JSON text itself."""
    return F.sha2(F.concat(F.lit('{"lsn": "'), lsn.cast("string"), F.lit('", "pk": '), pk_json, F.lit("}")), 256)


def valid(op: Column, before: Column, after: Column) -> Column:
    """An operation is c, u or d; a c has no before, a d no after."""
    ok = op.isin("c", "u", "d") & ~((op == "c") & before.isNotNull()) & ~((op == "d") & after.isNotNull())
    return F.coalesce(ok, F.lit(False))


def split_valid(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    ok = valid(F.col("op"), F.col("before"), F.col("after"))
    return events.where(ok), events.where(~ok)


def to_wire(events: DataFrame) -> DataFrame:
    """Every field as text, missing ones as the word null."""
    return events.select(*[F.coalesce(F.col(c).cast("string"), F.lit("null")).alias(c) for c in events.columns])


def from_wire(events: DataFrame) -> DataFrame:
    fields = T._parse_datatype_string(ENVELOPE).fields
    return events.select(*[F.nullif(F.col(f.name), F.lit("null")).cast(f.dataType).alias(f.name) for f in fields if f.name in events.columns])


def decode(events: DataFrame, schema: str, keep: list[str] | None = None) -> DataFrame:
    """The row an event is about, with its types: after, else before; keep adds event columns."""
    image = F.coalesce(F.from_json("after", schema), F.from_json("before", schema))
    return events.select(*(keep or []), image.alias("__row")).select(*(keep or []), "__row.*")


def compact(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last event of each key; events with a null in their key are all kept."""
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    rest = [c for c in events.columns if c not in keys]
    last = events.where(known).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__last")).select(*keys, "__last.*")
    return last.select(*events.columns).unionByName(events.where(~known))


def rekeyed(events: DataFrame, key: str, old_key: str) -> DataFrame:
    """An update that changes its key becomes a delete of the old one and an upsert of the new one."""
    moved = (F.col("op") == "u") & F.col(old_key).isNotNull() & (F.col(old_key) != F.col(key))
    return events.unionByName(events.where(moved).withColumns({key: F.col(old_key), "op": F.lit("d")}))


def split(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Upserts and deletes of compacted events."""
    return events.where("op IN ('c', 'u', 'r')"), events.where("op = 'd'")


def route(events: DataFrame, routes: DataFrame) -> DataFrame:
    """A copy of each event per matching route (schema_name, table_name or *, target); a route for a schema and all its tables does not exist.

    Routes are gathered by what they ask for, so an event meets three rows at most, of small tables that Spark
    broadcasts, and is only multiplied by the routes that it takes.
    """
    some = lambda where: routes.where(where)
    own = some("NOT (route_schema = '*' AND route_table = '*') AND route_table <> '*'").groupBy("route_schema", "route_table").agg(F.collect_list("target").alias("__targets"))
    named = own.where("route_schema <> '*'").withColumnRenamed("__targets", "__named")
    anywhere = own.where("route_schema = '*'").select(F.col("route_table").alias("__table"), F.col("__targets").alias("__anywhere"))
    every = some("route_schema = '*' AND route_table = '*'").agg(F.collect_list("target").alias("__every"))
    # An event that is itself called * takes each route once.
    met = events.join(named, (F.col("schema_name") == F.col("route_schema")) & (F.col("table_name") == F.col("route_table")), "left").join(anywhere, F.col("table_name") == F.col("__table"), "left").join(F.broadcast(every))
    none = F.array().cast("array<string>")
    return met.withColumn("target", F.explode(F.concat(F.coalesce("__named", none), F.coalesce("__anywhere", none), "__every"))).select(*events.columns, "target")


def in_order(events: DataFrame, connection: str = "source_id", order: list[str] | None = None) -> DataFrame:
    """The events of each connection in one partition and in order, as a sink that applies them one by one needs."""
    return events.repartition(connection).sortWithinPartitions(connection, *(order or ["lsn"]))


def tombstones(before: DataFrame, now: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of a full snapshot that are missing from the next: delete events."""
    return before.select(*keys).join(now.select(*keys), keys, "left_anti").withColumn("op", F.lit("d"))


def unapplied(events: DataFrame, ledger: DataFrame) -> DataFrame:
    """Events whose id the ledger does not hold, once each."""
    return events.dropDuplicates(["event_id"]).join(ledger.select("event_id"), "event_id", "left_anti")
