"""A declarative pipeline as one DataFrame plan, and the child tables it explodes."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import steps, tables
from ..functions.types import dsl
from ..sources.clean import whole_json


@dataclass
class Result:
    rows: DataFrame
    children: dict[str, DataFrame] = field(default_factory=dict)
    #: Rows whose JSON could not be read, where ``run`` was asked to set them aside.
    quarantine: DataFrame | None = None


def validate(spec: dict | str) -> list[dict]:
    """The steps of a spec {"transforms": [...]}, given as a dict or JSON text."""
    spec = json.loads(spec) if isinstance(spec, str) else spec
    found = spec.get("transforms", [])
    for i, step in enumerate(found):
        if "type" not in step:
            raise ValueError(f"step {i} has no type")
    return found


def flatten_child(df: DataFrame, step: dict) -> DataFrame:
    """Rows of a JSON array column with their parent's keys: whole items, or typed fields of objects."""
    column = F.col(steps.identifier(step["column"])).cast("string")
    if path := step.get("array_path"):
        column = F.get_json_object(column, path)
    keys = step.get("parent_keys") or [step.get("parent_key") or step.get("pk") or "id"]
    fields = step.get("output_columns") or {}
    kinds = step.get("json_schema") or {}
    exploded = df.select(*[F.col(steps.identifier(k)).alias(k if fields else f"parent_{k}") for k in keys], F.explode(F.from_json(column, "array<string>")).alias("item")).where("item IS NOT NULL")
    if not fields:
        return exploded
    fields = fields if isinstance(fields, dict) else {f: f for f in fields}
    items = [F.get_json_object("item", f"$.{f}").try_cast(dsl(kinds.get(f, "string"))).alias(steps.identifier(out)) for f, out in fields.items()]
    return exploded.select(*keys, *items)


def run(df: DataFrame, spec: dict | str, strict: bool = True, quarantine: bool = False) -> Result:
    """Applies the steps in order; Catalyst fuses them into one projection. strict=False skips unknown types.

    With quarantine, rows whose JSON columns hold no JSON take no part in any step and are returned beside the result.
    """
    children: dict[str, DataFrame] = {}
    bad = None
    if quarantine and (columns := [c for c in json_columns(spec) if c in df.columns]):
        df, bad = split_json(df, columns)
    for i, step in enumerate(validate(spec)):
        kind = step["type"]
        if kind == "json_flatten_child":
            children[step.get("child_table") or step.get("id") or f"child_{i}"] = flatten_child(df, step)
            drop = not step.get("keep_original", True)
        elif kind == "table_function":
            df, drop = tables.applied(df, step), False
        elif kind in steps.STEPS:
            df = df.withColumns(steps.STEPS[kind](step))
            drop = kind == "json_flatten_inline" and not step.get("keep_original", True)
        elif strict:
            raise ValueError(f"unknown step type {kind!r}")
        else:
            continue
        if drop:
            df = df.drop(step["column"])
    return Result(df, children, bad)


def json_columns(spec: dict | str) -> list[str]:
    """The columns of a pipeline's input that its steps read as JSON."""
    made, out = set(), []
    for step in validate(spec):
        if step["type"] in ("json_extract", "json_flatten_inline", "json_flatten_child") and step["column"] not in (*made, *out):
            out.append(step["column"])
        made |= {step[k] for k in ("output_column", "target_column") if isinstance(step.get(k), str)}
    return out


def split_json(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose columns each are one whole JSON value or null, and the others, which are for the quarantine."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | (F.col(c).isNotNull() & ~whole_json(F.col(c)))
    return df.where(~bad), df.where(bad)


def check_sql(spark: SparkSession, text: str) -> str:
    """The text of a pipeline if it is one query (tables in braces), as Spark's parser reads it; anything else raises."""
    try:
        spark._jsparkSession.sessionState().sqlParser().parseQuery(re.sub(r"\{(\w+)\}", r"\1", text))
    except Exception as e:  # noqa: BLE001
        raise ValueError(f"not a query: {str(e).strip()[:200]}") from None
    return text


def run_sql(spark: SparkSession, text: str, tables: dict[str, DataFrame]) -> DataFrame:
    """A pipeline given as one query over named tables, put in as arguments: no view outlives it."""
    return spark.sql(check_sql(spark, text), **tables)


def preview(df: DataFrame, spec: dict | str, rows: int = 20) -> DataFrame:
    """The first rows through the real pipeline."""
    return run(df.limit(rows), spec).rows


def select_and_map(df: DataFrame, selected: list[str] | None = None, mapping: dict[str, str | None] | None = None) -> DataFrame:
    """Whitelists columns (none: all), renames them, and drops those mapped to null."""
    df = df.select(*selected) if selected else df
    mapping = mapping or {}
    return df.drop(*[k for k, v in mapping.items() if v is None]).withColumnsRenamed({k: v for k, v in mapping.items() if v})
