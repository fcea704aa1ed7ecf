"""Schemas: inference by vote, difference, evolution, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import RANK, compatible, widened


def value_type(text: Column) -> Column:
    """bigint, double, boolean or string by the look of a JSON scalar's text; null for null."""
    return (
        F.when(text.isNull(), F.lit(None).cast("string"))
        .when(text.isin("true", "false"), "boolean")
        .when(text.rlike(r"^-?\d{1,18}$"), "bigint")
        .when(text.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), "double")
        .otherwise("string")
    )


def infer(df: DataFrame, json_column: str) -> DataFrame:
    """(field, type, present) of JSON objects: one type is it, numbers widen, a mixture or only nulls is string."""
    fields = df.select(F.explode(F.from_json(F.col(json_column), "map<string,string>")).alias("field", "value"))
    votes = fields.groupBy("field").agg(F.collect_set(value_type(F.col("value"))).alias("kinds"), F.count("value").alias("present"))
    kinds = F.col("kinds")
    numbers = F.size(F.array_except(kinds, F.array(F.lit("bigint"), F.lit("double")))) == 0
    kind = F.when(F.size(kinds) == 1, kinds[0]).when((F.size(kinds) > 1) & numbers, "double").otherwise("string")
    return votes.select("field", kind.alias("type"), "present")


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes between two catalogs (schema_name, table_name, column_name, data_type): one record a table or column.

    Removed tables and columns are breaking, and so are type changes that may lose values.
    """
    keys = ["schema_name", "table_name", "column_name"]
    tables = lambda df, c: df.groupBy("schema_name", "table_name").agg(F.lit(1).alias(c))
    t = tables(old, "in_old").join(tables(new, "in_new"), ["schema_name", "table_name"], "full_outer")
    whole = t.where("in_old IS NULL OR in_new IS NULL").select("schema_name", "table_name", F.lit(None).cast("string").alias("column_name"), F.when(F.col("in_old").isNull(), "table_added").otherwise("table_removed").alias("change"), F.lit(None).cast("string").alias("old_type"), F.lit(None).cast("string").alias("new_type"))
    both = t.where("in_old IS NOT NULL AND in_new IS NOT NULL").select("schema_name", "table_name")
    c = old.withColumnRenamed("data_type", "old_type").join(new.withColumnRenamed("data_type", "new_type"), keys, "full_outer").join(both, ["schema_name", "table_name"], "left_semi")
    change = F.when(F.col("old_type").isNull(), "column_added").when(F.col("new_type").isNull(), "column_removed").when(F.col("old_type") != F.col("new_type"), "type_changed")
    columns = c.withColumn("change", change).where("change IS NOT NULL").select(*keys, "change", "old_type", "new_type")
    lossless = [F.struct(F.lit(a), F.lit(b)) for a in [*RANK, "string", "date", "timestamp"] for b in [*RANK, "string", "date", "timestamp"] if compatible(a, b)]
    breaking = F.col("change").isin("table_removed", "column_removed") | ((F.col("change") == "type_changed") & ~F.struct("old_type", "new_type").isin(lossless))
    return whole.unionByName(columns).withColumn("is_breaking", F.coalesce(breaking, F.lit(False)))


def evolve(old: T.StructType, new: T.StructType) -> tuple[T.StructType, list[tuple[str, str, str | None, str]]]:
    """The schema that holds both, and the changes (column, added or widened, old type, new type)."""
    fields, changes = {f.name: f.dataType.simpleString() for f in old}, []
    for f in new:
        kind = f.dataType.simpleString()
        if f.name not in fields:
            changes.append((f.name, "added", None, kind))
            fields[f.name] = kind
        elif (wide := widened(fields[f.name], kind)) != fields[f.name]:
            changes.append((f.name, "widened", fields[f.name], wide))
            fields[f.name] = wide
    return T._parse_datatype_string(", ".join(f"`{k}` {v}" for k, v in fields.items())), changes


def reconcile(df: DataFrame, target: T.StructType) -> DataFrame:
    """df in the target's order and types, missing columns null, its own new columns at the end."""
    have = {c.lower(): c for c in df.columns}
    known = [(F.col(have[f.name.lower()]).cast(f.dataType) if f.name.lower() in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in target]
    names = {f.name.lower() for f in target}
    extra = [F.col(c).cast("string").alias(c) if isinstance(df.schema[c].dataType, T.NullType) else F.col(c) for c in df.columns if c.lower() not in names]
    return df.select(*known, *extra)


def patch_spec(spec: dict, column: str, change: str, new_type: str | None = None) -> dict:
    """A pipeline spec after a schema change: casts of a column follow its type, steps of a removed one go."""
    steps = spec.get("transforms", [])
    if change == "column_removed":
        steps = [s for s in steps if s.get("column") != column]
    elif change == "type_changed":
        if any(s["type"] == "cast" and s.get("column") == column for s in steps):
            steps = [s | {"to_type": new_type} if s["type"] == "cast" and s.get("column") == column else s for s in steps]
        else:
            steps = [{"type": "cast", "column": column, "to_type": new_type}, *steps]
    return spec | {"transforms": steps}
