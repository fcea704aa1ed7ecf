"""Parsing of change-log payloads into events, and reads of source tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..functions.types import json_candidate
from ..operators.sweep import positions
from . import clean

_WAL = "change array<struct<kind:string,schema:string,table:string,columnnames:array<string>,columnvalues:array<string>,oldkeys:struct<keynames:array<string>,keyvalues:array<string>>>>"


def wal(df: DataFrame, payload: str = "payload") -> DataFrame:
    """wal2json lines ({"change": [...]}) as op, schema_name, table_name, pk_values, before, after."""
    change = df.select("*", F.explode(F.from_json(payload, _WAL)["change"]).alias("c"))
    image = F.when(F.col("c.columnnames").isNotNull(), F.to_json(F.map_from_arrays("c.columnnames", "c.columnvalues")))
    old = F.when(F.col("c.oldkeys.keynames").isNotNull(), F.to_json(F.map_from_arrays("c.oldkeys.keynames", "c.oldkeys.keyvalues")))
    op = F.element_at(F.create_map(*[F.lit(x) for x in ("insert", "c", "update", "u", "delete", "d")]), F.col("c.kind"))
    after = F.when(op != "d", image)
    return change.select(op.alias("op"), F.col("c.schema").alias("schema_name"), F.col("c.table").alias("table_name"), F.coalesce(old, image).alias("pk_values"), F.when(op != "c", old).alias("before"), after.alias("after")).where("op IS NOT NULL")


def document_stream(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Document change-stream records as events; operations other than row changes are left out."""
    j = lambda p: F.get_json_object(payload, p)
    op = F.element_at(F.create_map(*[F.lit(x) for x in ("insert", "c", "update", "u", "replace", "u", "delete", "d")]), j("$.operationType"))
    key = j("$.documentKey")
    return df.select(op.alias("op"), j("$.ns.db").alias("schema_name"), j("$.ns.coll").alias("table_name"), key.alias("pk_values"), F.when(op == "d", key).alias("before"), F.when(op != "d", j("$.fullDocument")).alias("after"), j("$._id").alias("lsn")).where("op IS NOT NULL")


def resumed(records: DataFrame, tokens: DataFrame, collection: str = "collection", order: str = "position", token: str = "_id") -> tuple[DataFrame, DataFrame]:
    """The records of change streams after each collection's resume token, and the collections that need a new snapshot.

    records: collection, order and token of each entry and more; tokens: collection and token, where each was left. A
    collection without a token is read from its first record; one whose token its log no longer holds has lost history, and none of its records is given.
    """
    names = tokens.select(F.col(collection).alias("__c"), F.col(token).alias("__t"))
    found = records.join(names, F.col(collection) == F.col("__c")).groupBy("__c").agg(F.max(F.when(F.col(token) == F.col("__t"), F.col(order))).alias("__from"))
    # A row a collection.
    places = names.join(found.withColumnRenamed("__c", "__f"), F.col("__c") == F.col("__f"), "left").select("__c", "__from")
    lost = places.where("__from IS NULL").select(F.col("__c").alias(collection))
    met = records.join(places, F.col(collection) == F.col("__c"), "left")
    return met.where(F.col("__c").isNull() | (F.col(order) > F.col("__from"))).select(*records.columns), lost


def resume_tokens(records: DataFrame, collection: str = "collection", order: str = "position", token: str = "_id") -> DataFrame:
    """Where each collection was left: the token of its last record."""
    return records.groupBy(collection).agg(F.max_by(token, order).alias(token))


#: Words that make a statement of a log one that changes tables (fixed values).
DDL = ["ALTER", "CREATE", "DROP", "RENAME"]


def binlog(df: DataFrame, tables: list[tuple[str, str]] | None = None, names: dict[tuple[str, str], list[str]] | None = None) -> DataFrame:
    """Row events (event_type, schema_name, table_name, log_file, log_pos, before, after as JSON) as events.

    tables: only these (schema, table). names: a table's columns in order, for images whose keys
    are UNKNOWN_COL and a number.
    """
    op = F.element_at(F.create_map(*[F.lit(x) for x in ("write_rows", "c", "update_rows", "u", "delete_rows", "d")]), F.col("event_type"))
    of = F.struct("schema_name", "table_name")
    df = df.where(of.isin([F.struct(F.lit(s), F.lit(t)) for s, t in tables])) if tables else df
    image = lambda c: F.col(c)
    if names:
        known = F.create_map(*[x for (s, t), columns in names.items() for x in (F.struct(F.lit(s), F.lit(t)), F.array(*map(F.lit, columns)))])[of]
        pairs = lambda c: F.map_entries(F.from_json(c, "map<string,string>"))
        renamed = lambda c: F.to_json(F.map_from_entries(F.transform(F.slice(pairs(c), F.lit(1), F.greatest(F.lit(0), F.size(known))), lambda e, i: F.struct(known[i].alias("key"), e["value"].alias("value")))))
        image = lambda c: F.when(known.isNotNull() & F.contains(c, F.lit('"UNKNOWN_COL')), renamed(F.col(c))).otherwise(F.col(c))
    return df.select(op.alias("op"), "schema_name", "table_name", F.concat_ws(":", "log_file", F.col("log_pos").cast("string")).alias("lsn"), F.when(op != "c", image("before")).alias("before"), F.when(op != "d", image("after")).alias("after")).where("op IS NOT NULL")


def table_changes(df: DataFrame) -> DataFrame:
    """Statements of a log (event_type query, schema_name, query) that change tables."""
    return df.where((F.col("event_type") == "query") & F.upper("query").rlike(rf"^\s*(/\*.*?\*/\s*)*({'|'.join(DDL)})\b")).select("schema_name", "query")


def new_columns(events: DataFrame, catalog: DataFrame) -> DataFrame:
    """(schema_name, table_name, column_name): columns of events' after images that a catalog (of the same columns) lacks."""
    seen = events.where("after IS NOT NULL").select("schema_name", "table_name", F.explode(F.json_object_keys("after")).alias("column_name")).distinct()
    return seen.join(catalog.select("schema_name", "table_name", "column_name"), ["schema_name", "table_name", "column_name"], "left_anti")


def poll(df: DataFrame, cursor: str, last, limit: int | None = 1000) -> DataFrame:
    """The next rows after a cursor (without a limit, all of them), in its order, as creations."""
    rows = df if last is None else df.where(F.col(cursor) > F.lit(last))
    rows = rows.orderBy(cursor).limit(limit) if limit else rows
    return rows.withColumns({"op": F.lit("c"), "lsn": F.concat(F.lit("poll:"), F.col(cursor).cast("string"))})


def pages(df: DataFrame, key: str, limit: int) -> DataFrame:
    """All chunks of a snapshot at once: df with page, the number (from 0) of the keyset chunk of limit rows that a row lies in."""
    return positions(df, [], key).withColumn("page", F.floor((F.col("position") - 1) / limit)).drop("position", "size")


def jdbc(spark: SparkSession, url: str, table: str, conditions: list[str] | None = None, cursor: str | None = None, mark: str | None = None, **properties: str) -> DataFrame:
    """A source table over JDBC, one partition a condition, from a high-water mark on (the filter is pushed down)."""
    df = spark.read.jdbc(url, table, predicates=conditions, properties=properties) if conditions else spark.read.jdbc(url, table, properties=properties)
    return df if mark is None else df.where(F.col(cursor) >= F.lit(mark))


def jdbc_query(spark: SparkSession, url: str, query: str, **properties: str) -> DataFrame:
    """The result of a query that the source runs itself, so that only its rows travel."""
    return spark.read.format("jdbc").options(url=url, query=query, **properties).load()


#: Estimated rows of a table, out of what a source keeps about it (fixed values of those sources).
ESTIMATES = {
    "postgresql": "SELECT reltuples AS n FROM pg_class WHERE oid = '{schema}.{table}'::regclass",
    "mysql": "SELECT table_rows AS n FROM information_schema.tables WHERE table_schema = '{schema}' AND table_name = '{table}'",
}


def estimate_query(dialect: str, schema: str, table: str) -> str:
    if not all(x.replace("_", "").isalnum() for x in (schema, table)):
        raise ValueError(f"not a table name: {schema}.{table}")
    return ESTIMATES[dialect].format(schema=schema, table=table)


def footer_counts(spark: SparkSession, path: str, columns: list[str] | None = None) -> dict:
    """Rows of a Parquet table, and the least and greatest values of columns, out of the files' footers: no column is read.

    Spark's second Parquet source answers these aggregates from footers; partition values and
    numbers, dates and booleans can be asked for, texts can't. Evaluated at once.
    """
    with storage.settings(spark, FOOTERS):
        row = footer_plan(spark, path, columns).first()
    return row.asDict()


#: Settings under which aggregates are pushed into footers.
FOOTERS = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}


def footer_plan(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.agg(F.count("*").alias("rows"), *[f(c).alias(f"{k}_{c}") for c in columns or [] for k, f in (("min", F.min), ("max", F.max))])


def catalog_of(spark: SparkSession, url: str, schema_name: str, **properties: str) -> DataFrame:
    """All tables of a source over JDBC as catalog rows, with keys, nullability and JSON candidates, out of the driver's metadata.

    What is known of tables passes through the driver, none of their rows.
    """
    manager = spark._jvm.java.sql.DriverManager
    connection = manager.getConnection(url, *[properties[k] for k in ("user", "password")]) if "user" in properties else manager.getConnection(url)
    listed = lambda found, *names: _drained(found, names)
    try:
        meta = connection.getMetaData()
        keys = {}
        rows = []
        tables = [t["TABLE_NAME"] for t in listed(meta.getTables(None, schema_name, "%", None), "TABLE_NAME", "TABLE_TYPE") if t["TABLE_TYPE"] in ("TABLE", "BASE TABLE")]
        for t in tables:
            keys = {k["COLUMN_NAME"]: int(k["KEY_SEQ"]) for k in listed(meta.getPrimaryKeys(None, schema_name, t), "COLUMN_NAME", "KEY_SEQ")}
            for c in listed(meta.getColumns(None, schema_name, t, "%"), "COLUMN_NAME", "TYPE_NAME", "NULLABLE"):
                kind = c["TYPE_NAME"].lower()
                text = any(w in kind for w in ("char", "text", "clob", "string"))
                rows.append((schema_name, t, c["COLUMN_NAME"], kind, c["NULLABLE"] != "0", keys.get(c["COLUMN_NAME"]), text or json_candidate(kind)))
    finally:
        connection.close()
    return spark.createDataFrame(rows, CATALOG)


CATALOG = "schema_name string, table_name string, column_name string, data_type string, is_nullable boolean, key_position int, json_candidate boolean"


def _drained(found, names: tuple[str, ...]) -> list[dict[str, str]]:
    out = []
    while found.next():
        out.append({n: found.getString(n) for n in names})
    return out


def key_candidates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, total, nulls, distinct, is_key: which columns of a table could be its key, by its data: no null, no value twice.

    Each column is grouped for itself, so no task holds a column.
    """
    out = None
    for c in columns or df.columns:
        counts = df.groupBy(F.col(c).alias("v")).agg(F.count("*").alias("n"))
        one = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("nulls"), F.count("v").alias("distinct")).select(F.lit(c).alias("column"), "*")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("is_key", (F.col("total") > 0) & (F.col("nulls") == 0) & (F.col("distinct") == F.col("total")))


def documents(df: DataFrame, cursor: str | None = None, mark: str | None = None) -> DataFrame:
    """A batch read of a document collection: rows after a watermark in any known format (all of them,
    if it is in none), distinct names, the id as text, nested values as JSON."""
    if cursor and mark:
        since = df.sparkSession.range(1).select(clean.watermark(F.lit(mark))).first()[0]
        df = df if since is None else df.where(F.col(cursor) > F.lit(since))
    return clean.clean(clean.flat_id(clean.deduplicated_names(df)), lower=False)


def discovered(df: DataFrame, schema_name: str, table_name: str, keys: list[str] | None = None) -> DataFrame:
    """The columns of a table as catalog rows, with nullability, place in the key (from 1) and whether their type may hold JSON."""
    place = {k: i for i, k in enumerate(keys or [], 1)}
    rows = [(schema_name, table_name, f.name, f.dataType.simpleString(), f.nullable and f.name not in place, place.get(f.name), json_candidate(f.dataType.simpleString()) or f.dataType.simpleString() == "string") for f in df.schema]
    return df.sparkSession.createDataFrame(rows, "schema_name string, table_name string, column_name string, data_type string, is_nullable boolean, key_position int, json_candidate boolean")


def json_rate(c: Column) -> Column:
    """Share of non-null values that parse as JSON."""
    return F.count_if(F.try_parse_json(c).isNotNull()) / F.count(c)
