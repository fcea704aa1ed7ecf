"""Pipeline steps as Column expressions: cast, strings, math, dates, JSON, masks, SQL, functions.

A step is a dict with a type, most with a column, an optional output_column and parameters.
Every function returns {output name: Column}, so that a pipeline folds steps into projections.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import sel
from .division import guarded
from .types import dsl

_NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")
#: strftime codes as Java patterns (fixed values).
STRFTIME = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "p": "a", "j": "DDD", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "f": "SSSSSS", "%": "%"}
FUNCTIONS: dict[str, Callable] = {}


def register(name: str, function: Callable, return_type: str = "string") -> None:
    """Makes a Python function (Arrow-batched) or a UDF object available to udf steps."""
    FUNCTIONS[name] = function if hasattr(function, "returnType") else F.udf(function, dsl(return_type), useArrow=True)


def identifier(name: str) -> str:
    if not isinstance(name, str) or not _NAME.match(name):
        raise ValueError(f"not a column name: {name!r}")
    return name


def _col(step: dict) -> Column:
    return F.col(identifier(step["column"]))


def _get(step: dict, key: str, default=None):
    """A parameter of the step itself, or of its params or extra."""
    for at in (step, step.get("params") or {}, step.get("extra") or {}):
        if key in at and at[key] is not None:
            return at[key]
    return default


def _out(step: dict, default: str) -> str:
    return identifier(step.get("output_column") or default)


def _op(step: dict) -> str:
    return str(step.get("op") or step.get("operation") or "").lower()


def cast_to(c: Column, kind: str, on_error: str = "raise") -> Column:
    """on_error: raise, null, or keep (the original as text where the cast fails)."""
    if on_error == "raise":
        return c.cast(kind)
    tried = c.try_cast(kind)
    return tried if on_error == "null" else F.coalesce(tried.cast("string"), c.cast("string"))


def cast(step: dict) -> dict[str, Column]:
    kind = dsl(_get(step, "to_type") or _get(step, "target_type"), _get(step, "strict_types", True))
    return {_out(step, step["column"]): cast_to(_col(step), kind, _get(step, "on_error", "raise"))}


def string_op(step: dict) -> dict[str, Column]:
    c, op = _col(step).cast("string"), _op(step)
    lit = lambda k, d="": F.lit(str(_get(step, k, d)))
    if op in ("upper", "lower", "trim", "ltrim", "rtrim"):
        out = getattr(F, op)(c)
    elif op == "substring":
        start, n = max(0, int(_get(step, "start", 1))), max(0, int(_get(step, "length", 255)))
        out = F.substring(c, start or 1, n if start else max(0, n - 1))  # a start of 0 spends one of the length
    elif op == "replace":
        out = F.replace(c, lit("from"), lit("to")) if _get(step, "from", "") else c
    elif op == "concat":
        out = F.concat_ws("", c, lit("suffix"))  # null counts as empty
    elif op in ("lpad", "rpad"):
        out = getattr(F, op)(c, int(_get(step, "length", 10)), str(_get(step, "pad", " ")))
    elif op == "regexp_replace":
        out = F.regexp_replace(c, lit("pattern"), lit("to"))
    else:
        raise ValueError(f"unknown string operation {op!r}")
    return {_out(step, step["column"]): out}


def math_op(step: dict) -> dict[str, Column]:
    text = step["expression"]
    if _get(step, "on_error", "raise") == "null":
        text = guarded(text)
    return {_out(step, step.get("column") or "math_result"): F.expr(text).cast(dsl(_get(step, "output_type", "double")))}


def java_pattern(pattern: str) -> str:
    """A strftime pattern as a Java one; a pattern without % is one already."""
    if "%" not in pattern:
        return pattern
    out, at = [], 0
    while at < len(pattern):
        if pattern[at] == "%" and at + 1 < len(pattern):
            if pattern[at + 1] not in STRFTIME:
                raise ValueError(f"unknown date code %{pattern[at + 1]}")
            out.append(STRFTIME[pattern[at + 1]])
            at += 2
        else:
            end = at
            while end < len(pattern) and pattern[end].isalpha():
                end += 1
            out.append(f"'{pattern[at:end]}'" if end > at else pattern[at])
            at = max(end, at + 1)
    return "".join(out)


_UNITS = {"microsecond", "millisecond", "second", "minute", "hour", "day", "week", "month", "quarter", "year"}


def _unit(step: dict) -> str:
    unit = str(_get(step, "unit", "day")).lower().rstrip("s")
    if unit not in _UNITS:
        raise ValueError(f"unknown unit {unit!r}")
    return unit


def date_op(step: dict) -> dict[str, Column]:
    op, name = _op(step), identifier(step["column"])
    ts = F.col(name).cast("timestamp")
    if op in ("year", "month", "day", "hour", "minute"):
        out = getattr(F, {"day": "dayofmonth"}.get(op, op))(ts)
    elif op == "epoch":
        out = F.unix_micros(ts) / F.lit(1e6)
    elif op == "date_format":
        out = F.date_format(ts, java_pattern(str(_get(step, "format", "yyyy-MM-dd"))))
    elif op == "date_add":
        n = int(_get(step, "value", _get(step, "days", 1)))
        out = F.expr(f"timestampadd({_unit(step)}, {n}, CAST({name} AS timestamp))")
    elif op == "date_diff":
        other, unit = identifier(_get(step, "other")), _unit(step)
        # Boundaries crossed: both sides are cut to the unit first.
        cut = lambda c: f"date_trunc('{unit}', CAST({c} AS timestamp))"
        out = F.expr(f"timestampdiff({unit}, {cut(name)}, {cut(other)})")
    else:
        raise ValueError(f"unknown date operation {op!r}")
    kind = _get(step, "output_type")
    return {_out(step, f"{name}_{op}"): out.cast(dsl(kind)) if kind else out}


def json_extract(step: dict) -> dict[str, Column]:
    found = F.get_json_object(_col(step).cast("string"), _get(step, "json_path") or _get(step, "path", "$.value"))
    kind = dsl(_get(step, "output_type") or _get(step, "to_type", "string"))
    return {_out(step, f"{step['column']}_value"): found if kind == "string" else found.try_cast(kind)}


def json_flatten_inline(step: dict) -> dict[str, Column]:
    """One column per field of json_schema; a field that does not fit is null."""
    fields = {identifier(k): dsl(v) for k, v in _get(step, "json_schema").items()}
    names = _get(step, "output_columns") or {}
    names = names if isinstance(names, dict) else dict(zip(fields, names, strict=True))
    parsed = F.from_json(_col(step).cast("string"), ", ".join(f"`{k}` {v}" for k, v in fields.items()))
    return {identifier(names.get(k, f"{step['column']}_{k}")): parsed[k] for k in fields}


def mask(step: dict) -> dict[str, Column]:
    c = _col(step).cast("string")
    n = F.length(c)
    stars = lambda k: F.repeat(F.lit("*"), k)
    kinds = {
        "last4": lambda: F.when(n > 4, F.concat(stars(n - 4), F.substr(c, n - 3))).otherwise(c),
        "first4": lambda: F.when(n > 4, F.concat(F.substr(c, F.lit(1), F.lit(4)), stars(n - 4))).otherwise(c),
        "hash": lambda: F.sha2(c, 256),
        "null": lambda: F.nullif(_col(step), _col(step)),
        "email": lambda: F.when(F.instr(c, "@") > 0, F.concat(F.substring(c, 1, 1), F.lit("***"), F.substr(c, F.instr(c, "@")))).otherwise(stars(n)),
        "full": lambda: stars(n),
    }
    name = str(_get(step, "strategy") or _op(step)).lower()
    name = {"nullify": "null", "email_domain": "email"}.get(name, name)
    if name not in kinds:
        raise ValueError(f"unknown mask {name!r}")
    return {_out(step, step["column"]): kinds[name]()}


def expression(step: dict) -> dict[str, Column]:
    text, language = step["expression"], str(_get(step, "language", "spark_sql")).lower()
    if ";" in re.sub(r"'(?:[^']|'')*'", "", text):
        raise ValueError("one expression is wanted")
    out = F.expr(sel.to_sql(text) if language == "sel" else text)
    kind = _get(step, "output_type")
    return {_out(step, "expr_result"): out.cast(dsl(kind)) if kind else out}


def udf(step: dict) -> dict[str, Column]:
    name = step.get("function") or step.get("udf_name")
    args = [F.col(identifier(c)) for c in step.get("args") or [step["column"]]]
    return {_out(step, f"{name}_result"): FUNCTIONS[name](*args) if name in FUNCTIONS else F.call_function(name, *args)}


STEPS: dict[str, Callable[[dict], dict[str, Column]]] = {
    "cast": cast, "string_op": string_op, "math_op": math_op, "date_op": date_op, "json_extract": json_extract,
    "json_flatten_inline": json_flatten_inline, "mask": mask, "expression": expression, "udf": udf,
}
