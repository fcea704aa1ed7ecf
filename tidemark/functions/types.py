"""Type names of pipelines and sources, widening, and compatible changes."""

from __future__ import annotations

# Type names that a pipeline may use.
DSL = {
    "string": "string", "str": "string", "int": "int", "integer": "int", "long": "bigint", "bigint": "bigint",
    "tinyint": "tinyint", "smallint": "smallint", "double": "double", "float": "float", "boolean": "boolean",
    "bool": "boolean", "timestamp": "timestamp", "date": "date", "decimal": "decimal(38,18)",
}
# Source types that are not strings.
SOURCE = {
    "tinyint": "tinyint", "smallint": "smallint", "int2": "smallint", "int": "int", "integer": "int", "int4": "int", "mediumint": "int", "year": "int",
    "bigint": "bigint", "int8": "bigint", "float": "float", "real": "float", "double": "double", "double precision": "double", "float8": "double",
    "decimal": "decimal(38,18)", "numeric": "decimal(38,18)", "money": "decimal(19,4)", "bool": "boolean", "boolean": "boolean", "bit": "boolean",
    "date": "date", "datetime": "timestamp", "timestamp": "timestamp", "timestamptz": "timestamp", "timestamp with time zone": "timestamp",
    "binary": "binary", "varbinary": "binary", "blob": "binary", "bytea": "binary",
}
#: Numeric types, narrow to wide.
RANK = ["boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "decimal(38,18)"]
JSON_TYPES = {"json", "jsonb", "text", "longtext", "mediumtext", "clob"}


def dsl(name: str, strict: bool = True) -> str:
    """Spark's name of a pipeline type; an unknown one raises, or is a string if not strict."""
    key = name.strip().lower()
    if key not in DSL:
        if strict:
            raise ValueError(f"unknown type {name!r}")
        return "string"
    return DSL[key]


def of_source(name: str) -> str:
    """Spark's name of a source type, parameters ignored; unknown ones are strings."""
    return SOURCE.get(name.lower().split("(")[0].strip(), "string")


def widened(a: str, b: str) -> str:
    """The narrowest type that holds both: the wider number, else string."""
    if a == b:
        return a
    if a in RANK and b in RANK and "boolean" not in (a, b):
        return RANK[max(RANK.index(a), RANK.index(b))]
    return "timestamp" if {a, b} == {"date", "timestamp"} else "string"


def compatible(old: str, new: str) -> bool:
    """Whether a column may change from old to new without losing values."""
    return widened(old, new) == new


def json_candidate(declared: str) -> bool:
    return declared.lower().split("(")[0].strip() in JSON_TYPES
