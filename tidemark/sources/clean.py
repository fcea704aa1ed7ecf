"""Cleaning of batch reads: blanks, NUL bytes, names, nested values, audit time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Formats in which a watermark may be written (fixed values).
WATERMARKS = [
    "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm",
    "yyyy/MM/dd HH:mm:ss.SSSSSS", "yyyy/MM/dd HH:mm:ss.SSS", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ssXXX",
]


def watermark(text: Column) -> Column:
    """A timestamp out of any of the formats, else null."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in WATERMARKS])


def clean(df: DataFrame, now: Column | None = None, zone: str = "Asia/Kolkata", lower: bool = True) -> DataFrame:
    """Blank text as null, NUL removed, struct and array as JSON text, an audit time, lower-case names."""
    out = {}
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            c = F.translate(c, "\0", "")
            out[f.name] = F.when(F.trim(c) != "", c)
        elif isinstance(f.dataType, (T.StructType, T.MapType)):
            out[f.name] = F.coalesce(F.to_json(c), F.lit("{}"))
        elif isinstance(f.dataType, T.ArrayType):
            out[f.name] = F.coalesce(F.to_json(c), F.lit("[]"))
    if now is not None:
        out["audit_updated_date"] = F.from_utc_timestamp(now, zone)
    df = df.withColumns(out) if out else df
    return df.toDF(*[c.lower() for c in df.columns]) if lower else df


def unique_names(names: list[str]) -> list[str]:
    """Names made distinct without regard to case by a counter at the end."""
    seen: dict[str, int] = {}
    out, taken = [], {n.lower() for n in names}
    for n in names:
        k = n.lower()
        seen[k] = seen.get(k, -1) + 1
        name = n
        while seen[k] and (name := f"{n}_{seen[k]}").lower() in taken:
            seen[k] += 1
        taken.add(name.lower())
        out.append(name)
    return out


def text_or_hex(c: Column) -> Column:
    """Bytes as text where they are UTF-8, else as hex."""
    return F.coalesce(F.try_validate_utf8(c.cast("string")), F.lower(F.hex(c)))


def whole_json(c: Column) -> Column:
    """Whether a text is one JSON value with nothing behind it; parsers stop after the first value, so it is looked at inside an object that has to end as it should."""
    end = "__end_of_value"
    inside = F.concat(F.lit('{"value":'), c, F.lit(f',"{end}":1}}'))
    whole = (F.json_object_keys(inside) == F.array(F.lit("value"), F.lit(end))) & F.try_parse_json(inside).isNotNull()
    return F.coalesce(whole, F.lit(False))


def _readable(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BinaryType):
        return text_or_hex(c)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _readable(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.map_from_entries(F.transform(F.map_entries(c), lambda e: F.struct(_readable(e["key"], kind.keyType).alias("key"), _readable(e["value"], kind.valueType).alias("value"))))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_readable(c[f.name], f.dataType).alias(f.name) for f in kind]))
    return c


def readable(df: DataFrame) -> DataFrame:
    """df with all bytes as text or hex, however deep in its columns."""
    return df.select(*[_readable(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema])


def flat_id(df: DataFrame, name: str = "_id") -> DataFrame:
    """df with a document id as text: the oid (or $oid) of an object, else the value itself."""
    if name not in df.columns:
        return df
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.StructType):
        c = F.coalesce(F.get_json_object(F.to_json(c), "$.oid"), F.get_json_object(F.to_json(c), "$['$oid']"))
    return df.withColumn(name, c.cast("string"))


def as_text(df: DataFrame, target: T.StructType) -> DataFrame:
    """df where every column that a text column of the target awaits is text: nested ones as JSON, bytes as text or hex."""
    kinds, out = {f.name: f.dataType for f in target}, {}
    for f in df.schema:
        if isinstance(kinds.get(f.name), T.StringType) and not isinstance(f.dataType, T.StringType):
            c = F.col(f"`{f.name}`")
            nested = isinstance(f.dataType, (T.StructType, T.MapType, T.ArrayType))
            out[f.name] = F.to_json(_readable(c, f.dataType)) if nested else text_or_hex(c) if isinstance(f.dataType, T.BinaryType) else c.cast("string")
    return df.withColumns(out) if out else df


def deduplicated_names(df: DataFrame) -> DataFrame:
    """df with column names that differ without regard to case."""
    return df.toDF(*unique_names(df.columns))
