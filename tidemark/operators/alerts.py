"""Alert rules over metrics: thresholds, changes, anomalies and patterns, as episodes with a beginning and an end.

Samples become one series of window means a metric and group, written once; every rule is a flag on it, and episodes are runs of
flagged windows. A group is as long as its windows, however many samples it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import storage
from . import metrics

#: What a condition may say (fixed values).
KINDS = {"threshold": ("metric", "operator", "value"), "change": ("metric", "change_type", "threshold"), "anomaly": ("metric", "sensitivity"), "pattern": ("metric", "pattern")}
OPERATORS = {"gt": Column.__gt__, "gte": Column.__ge__, "lt": Column.__lt__, "lte": Column.__le__, "eq": Column.__eq__, "ne": Column.__ne__}
CHANGES = ("increase", "decrease", "change")


def checked(rule: dict) -> dict:
    """The rule {"alert", "condition_type", "condition", ...} with its defaults; unknown and missing parts raise."""
    kind, condition = rule.get("condition_type"), rule.get("condition", {})
    if kind not in KINDS:
        raise ValueError(f"condition_type must be one of {', '.join(KINDS)}")
    if missing := [f for f in KINDS[kind] if f not in condition]:
        raise ValueError(f"{kind} needs {', '.join(missing)}")
    for key, allowed in (("operator", OPERATORS), ("change_type", CHANGES), ("sensitivity", metrics.SENSITIVITY)):
        if key in condition and condition[key] not in allowed:
            raise ValueError(f"{key} must be one of {', '.join(allowed)}")
    return {"severity": "warning", "window_minutes": 5, "consecutive_failures": 1, "suppression_window_minutes": 0} | rule


def flagged(series: DataFrame, rule: dict, by: list[str], seconds: int) -> DataFrame:
    """by, start, value, flag (never null) of one metric's windows."""
    kind, c = rule["condition_type"], rule["condition"]
    if kind == "threshold":
        flag = OPERATORS[c["operator"]](F.col("value"), F.lit(c["value"]))
        return series.select(*by, "start", "value", F.coalesce(flag, F.lit(False)).alias("flag"))
    keys = [*by, "start"]
    if kind == "change":
        found = metrics.changed(series, by, c["threshold"], seconds * c.get("windows", 1))
        side = {"increase": F.col("change") > 0, "decrease": F.col("change") < 0, "change": F.lit(True)}[c["change_type"]]
        hits = found.where(side)
    elif kind == "anomaly":
        hits = metrics.outliers(series, by, int(c.get("baseline_days", 7) * 86_400), metrics.SENSITIVITY[c["sensitivity"]])
    else:  # a list of conditions on value, one a window, that windows meet one after another
        steps = c["pattern"] if isinstance(c["pattern"], list) else [c["pattern"]]
        found = metrics.sequences(series, by, steps, seconds * len(steps), "start")
        hits = found.select(*by, F.col("last").alias("start"))
    hits = hits.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct().withColumn("__hit", F.lit(True))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return series.join(hits, same, "left").select(*by, "start", "value", F.col("__hit").isNotNull().alias("flag"))


def episodes(windows: DataFrame, by: list[str], seconds: int, consecutive: int = 1) -> DataFrame:
    """by, triggered_at, resolved_at, windows, peak: runs of flagged windows, at least consecutive of them one after another.

    A run triggers in the window that makes it long enough and is resolved at the end of its last one; resolved_at is
    null while it lasts, up to the group's last window. A missing window ends a run.
    """
    order = Window.partitionBy(*by).orderBy("start")
    at = F.unix_seconds("start")
    new = ~F.coalesce(F.lag("flag").over(order) & (at - F.lag(at).over(order) == seconds), F.lit(False))
    runs = windows.withColumn("__newest", F.max("start").over(Window.partitionBy(*by))).withColumn("__new", (F.col("flag") & new).cast("int"))
    runs = runs.withColumn("__run", F.sum("__new").over(order)).where("flag")
    found = runs.groupBy(*by, "__run").agg(F.min("start").alias("first"), F.max("start").alias("last"), F.count("*").alias("windows"), F.max("value").alias("peak"), F.first("__newest").alias("__newest"))
    after = lambda c, n: F.timestamp_seconds(F.unix_seconds(c) + n)
    found = found.where(F.col("windows") >= consecutive)
    return found.select(*by, after("first", seconds * (consecutive - 1)).alias("triggered_at"), F.when(F.col("last") < F.col("__newest"), after("last", seconds)).alias("resolved_at"), "windows", "peak")


def suppressed(found: DataFrame, by: list[str], seconds: int) -> DataFrame:
    """Episodes without those that trigger within so many seconds of the last one of their group that was let through."""
    if not seconds:
        return found
    others = [c for c in found.columns if c not in by]
    start = F.array().cast(f"array<struct<{', '.join(f'{f.name}:{f.dataType.simpleString()}' for f in found.select(*others).schema)}>>")
    at = lambda x: F.unix_seconds(x["triggered_at"])
    keep = lambda acc, x: F.when((F.size(acc) > 0) & (at(x) - at(F.element_at(acc, -1)) < seconds), acc).otherwise(F.concat(acc, F.array(x)))
    # One array a group, of its episodes: no longer than its windows.
    lists = found.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("triggered_at", *[c for c in others if c != "triggered_at"]))).alias("__all"))
    same = F.transform("__all", lambda x: F.struct(*[x[c].alias(c) for c in others]))
    return lists.withColumn("__kept", F.explode(F.aggregate(same, start, keep))).select(*by, "__kept.*").select(*found.columns)


def alerts(samples: DataFrame, rules: list[dict], by: list[str], ts: str = "ts") -> DataFrame:
    """by, alert, severity, triggered_at, resolved_at, windows, peak for all rules, of samples (by, ts, metric, value)."""
    rules = [checked(r) for r in rules]
    series: dict[int, DataFrame] = {}
    out = None
    for rule in rules:
        minutes, seconds = rule["window_minutes"], rule["window_minutes"] * 60
        if minutes not in series:
            asked = sorted({r["condition"]["metric"] for r in rules if r["window_minutes"] == minutes})
            series[minutes] = storage.written(metrics.buckets(samples.where(F.col("metric").isin(asked)), [*by, "metric"], ts, "value", f"{minutes} minutes"), "series")
        own = series[minutes].where(F.col("metric") == rule["condition"]["metric"]).drop("metric")
        found = suppressed(episodes(flagged(own, rule, by, seconds), by, seconds, rule["consecutive_failures"]), by, rule["suppression_window_minutes"] * 60)
        found = found.select(*by, F.lit(rule["alert"]).alias("alert"), F.lit(rule["severity"]).alias("severity"), "triggered_at", "resolved_at", "windows", "peak")
        out = found if out is None else out.unionByName(found)
    return out
