"""Operational metrics: lag, rates, failure summaries, alerts, usage."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .apply import upsert
from .sweep import positions

#: Time ranges of views (fixed values).
RANGES = {"1h": timedelta(hours=1), "24h": timedelta(hours=24), "7d": timedelta(days=7), "30d": timedelta(days=30)}


def lag(events: DataFrame, now: Column, ts: str = "ts", by: list[str] | None = None) -> DataFrame:
    """Greatest and mean seconds between an event and now."""
    seconds = (F.unix_micros(now) - F.unix_micros(ts)) / 1e6
    return events.groupBy(*(by or [])).agg(F.max(seconds).alias("max_lag"), F.avg(seconds).alias("avg_lag"), F.count("*").alias("events"))


def rate(events: DataFrame, ts: str = "ts", size: str = "5 minutes", slide: str | None = None, by: list[str] | None = None, seconds: int = 300) -> DataFrame:
    """Events a second in windows of event time."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return events.groupBy(w.alias("w"), *(by or [])).agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), *(by or []), "events", (F.col("events") / seconds).alias("rate"))


def tier(rows: Column) -> Column:
    """Size class of a table by rows."""
    return F.when(rows < 1_000_000, "S").when(rows < 20_000_000, "M").when(rows < 200_000_000, "L").otherwise("XL")


def trend(today: Column, before: Column) -> Column:
    return F.when(today > before * 1.2, "increasing").when(today < before * 0.8, "decreasing").otherwise("stable")


def moving_average(df: DataFrame, by: list[str], order: str, value: str, alpha: float = 0.3, ties: list[str] | None = None) -> DataFrame:
    """The exponential moving average of each group after its last row: a sum of all rows, each weighed by its position."""
    age = F.col("size") - F.col("position")
    weight = F.pow(F.lit(1 - alpha), age) * F.when(F.col("position") == 1, 1.0).otherwise(alpha)
    return positions(df, by, order, ties).groupBy(*by).agg(F.sum(weight * F.col(value)).alias("ema"))


def rolling(events: DataFrame, by: list[str], seconds: int = 1, ts: str = "ts") -> DataFrame:
    """events with recent: how many of their group came in the seconds up to each (RANGE frame), itself and its instant included.

    Counted by instant first, and groups are cut by time so that a busy one is many tasks' work.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    span = seconds * 1_000_000
    instants = events.groupBy(*by, micros.alias("__at")).agg(F.count("*").alias("__n"))
    cut = F.floor(F.col("__at") / (span * 4))
    cuts = F.when(F.col("__at") % (span * 4) >= span * 3, F.array(cut, cut + 1)).otherwise(F.array(cut))  # what the next cut looks back to
    frame = Window.partitionBy(*by, "__cut").orderBy("__at").rangeBetween(-(span - 1), 0)
    dealt = instants.withColumns({"__own": cut, "__cut": F.explode(cuts)}).withColumn("recent", F.sum("__n").over(frame)).where(F.col("__own") == F.col("__cut"))
    names = {b: f"__{i}" for i, b in enumerate(by)}
    held = dealt.select(*[F.col(b).alias(n) for b, n in names.items()], "__at", "recent")
    return events.join(held, [*[F.col(b).eqNullSafe(F.col(n)) for b, n in names.items()], micros == F.col("__at")]).select(*events.columns, "recent")


def remaining(done: Column, total: Column, rate: Column) -> Column:
    """Seconds until done reaches total at rate a second; null where nothing moves."""
    return F.when(rate > 0, F.greatest(F.lit(0), total - done) / rate)


def within(df: DataFrame, ts: str, span: str, now: datetime) -> DataFrame:
    """Rows of the last 1h, 24h, 7d or 30d; the filter reaches the scan."""
    if span not in RANGES:
        raise ValueError(f"unknown time range {span!r}")
    return df.where((F.col(ts) >= F.lit(now - RANGES[span])) & (F.col(ts) <= F.lit(now)))


def threshold_alerts(samples: DataFrame, rules: list[dict], by: list[str], ts: str = "ts", window: str = "5 minutes") -> DataFrame:
    """by, start, alert, severity, value: windows in which every sample of a metric (metric, value) is above a rule's bound.

    rules: {"alert", "metric", "above", "severity"}. One that holds through a window fires.
    """
    w = F.window(ts, window)
    least = samples.groupBy(w.alias("w"), *by, "metric").agg(F.min("value").alias("least"), F.max("value").alias("value"))
    of = F.array(*[F.struct(F.lit(r["alert"]).alias("alert"), F.lit(r["metric"]).alias("metric"), F.lit(float(r["above"])).alias("above"), F.lit(r.get("severity", "warning")).alias("severity")) for r in rules])
    met = least.withColumn("rule", F.explode(of)).where((F.col("metric") == F.col("rule.metric")) & (F.col("least") > F.col("rule.above")))
    return met.select(*by, F.col("w.start").alias("start"), "rule.alert", "rule.severity", "value")


def alert_statistics(alerts: DataFrame, by: list[str], now: datetime) -> DataFrame:
    """Counts of alerts (severity, acknowledged, resolved, triggered_at, resolved_at) by state, severity and age, and mean minutes to resolution."""
    open_, at = ~F.col("resolved"), F.col("triggered_at")
    counts = {"total": F.lit(True), "active": open_ & ~F.col("acknowledged"), "acknowledged": open_ & F.col("acknowledged"), "resolved": F.col("resolved")}
    counts |= {s: F.col("severity") == s for s in ("critical", "error", "warning", "info")}
    counts |= {f"last_{k}": at >= F.lit(now - RANGES[k]) for k in ("24h", "7d")}
    minutes = F.avg(F.when(F.col("resolved"), (F.unix_micros("resolved_at") - F.unix_micros(at)) / 60e6))
    return alerts.groupBy(*by).agg(*[F.count_if(c).alias(f"n_{k}") for k, c in counts.items()], minutes.alias("mean_minutes"))


def queue_status(letters: DataFrame, by: list[str], open_: Column, critical: float = 0.1) -> DataFrame:
    """Dead letters by group: total, still open, and ok, degraded or critical by the share that is open."""
    counts = letters.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(open_).alias("open"))
    return counts.withColumn("status", F.when(F.col("open") == 0, "ok").when(F.col("open") > F.col("total") * critical, "critical").otherwise("degraded"))


def daily_usage(usage: DataFrame | None, rows: DataFrame, keys: list[str], ts: str, measures: dict[str, Column]) -> DataFrame:
    """A rollup by keys and day; days that rows bring replace those of usage."""
    days = rows.groupBy(*keys, F.to_date(ts).alias("day")).agg(*[c.alias(k) for k, c in measures.items()])
    return days if usage is None else upsert(usage, days, [*keys, "day"])


def page(df: DataFrame, filters: dict | None = None, order: list[Column] | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of a list: equality filters (a list: any of), an order, limit and offset."""
    for name, value in (filters or {}).items():
        df = df.where(F.col(name).isin(value) if isinstance(value, (list, tuple)) else F.col(name).eqNullSafe(F.lit(value)))
    return (df.orderBy(*order) if order else df).offset(offset).limit(limit)


def latest_of(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The last row of each key, without a sort."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("__v")).select(*keys, "__v.*")


def anomalies(df: DataFrame, value: str, by: list[str], z: float = 3.0) -> DataFrame:
    """Rows further than z deviations from their group's mean."""
    stats = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev(value).alias("dev"))
    return df.join(stats, by).where(F.abs(F.col(value) - F.col("mean")) > z * F.col("dev"))


#: Robust deviations that a sensitivity allows.
SENSITIVITY = {"low": 5.0, "medium": 3.5, "high": 2.5}


def detect(series: DataFrame, by: list[str], config: dict, ts: str = "start", value: str = "value") -> DataFrame:
    """Anomalous points of a series under {"detection_type", "sensitivity", "baseline_period_days", "config"}.

    statistical: against the median of the baseline before the point; threshold: outside config's min and max; pattern: the
    last points of runs that meet config's conditions one by one.
    """
    kind, more = config.get("detection_type"), config.get("config", {})
    if config.get("sensitivity", "medium") not in SENSITIVITY:
        raise ValueError(f"sensitivity must be one of {', '.join(SENSITIVITY)}")
    days = config.get("baseline_period_days", 7)
    if not 1 <= days <= 90:
        raise ValueError("baseline_period_days must be from 1 to 90")
    if kind == "statistical":
        return outliers(series, by, days * 86_400, SENSITIVITY[config.get("sensitivity", "medium")], ts=ts, value=value).select(*series.columns)
    if kind == "threshold":
        low, high = more.get("min"), more.get("max")
        bad = (F.col(value) < low if low is not None else F.lit(False)) | (F.col(value) > high if high is not None else F.lit(False))
        return series.where(F.coalesce(bad, F.lit(False)))
    if kind == "pattern":
        ends = sequences(series, by, more["conditions"], more.get("within", days * 86_400), ts)
        names = {c: f"__{i}" for i, c in enumerate([*by, ts])}
        held = ends.select(*by, F.col("last").alias(ts)).distinct().withColumnsRenamed(names)
        return series.join(held, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()], "left_semi")
    raise ValueError("detection_type must be one of statistical, threshold, pattern")


def buckets(samples: DataFrame, by: list[str], ts: str = "ts", value: str = "value", size: str = "5 minutes") -> DataFrame:
    """by, start, value: means of windows of event time; what rules over time look at, so that a busy group is as long as its time."""
    return samples.groupBy(F.window(ts, size).alias("w"), *by).agg(F.avg(value).alias("value")).select(*by, F.col("w.start").alias("start"), "value")


def daily(events: DataFrame, ts: str = "ts") -> DataFrame:
    """day, n, trend: events a day, against those of the day before."""
    days = events.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))
    before = days.select(F.date_add("day", 1).alias("day"), F.col("n").alias("before"))
    return days.join(before, "day", "left").select("day", "n", trend(F.col("n"), F.col("before")).alias("trend"))


def _seconds(ts: str) -> Column:
    return F.unix_seconds(F.col(ts).cast("timestamp"))


def changed(series: DataFrame, by: list[str], percent: float, seconds: int, ts: str = "start", value: str = "value") -> DataFrame:
    """Points of a series whose value is off by more than percent from the one a given time earlier (RANGE frame: exactly there); change is signed."""
    at = Window.partitionBy(*by).orderBy(_seconds(ts)).rangeBetween(-seconds, -seconds)
    before = F.first(value).over(at)
    change = F.when(before != 0, (F.col(value) - before) * 100 / F.abs(before))
    return series.withColumns({"before": before, "change": change}).where(F.abs("change") > percent)


def _middle(values: Column) -> Column:
    """The lower median of an array without nulls."""
    return F.element_at(F.array_sort(values), F.floor((F.size(values) + 1) / 2).cast("int"))


def outliers(series: DataFrame, by: list[str], seconds: int, k: float = 3.5, least: int = 5, ts: str = "start", value: str = "value") -> DataFrame:
    """Points further than k robust deviations from the median of the time before them, where that has least points.

    The deviation is 1.4826 times the median distance from that median, so that single spikes do not hide the
    next one; the frame is a RANGE of event time, of as many points as its buckets.
    """
    frame = Window.partitionBy(*by).orderBy(_seconds(ts)).rangeBetween(-seconds, -1)
    held = series.where(F.col(value).isNotNull()).withColumn("__held", F.collect_list(value).over(frame)).where(F.size("__held") >= least)
    held = held.withColumn("median", _middle(F.col("__held")))
    held = held.withColumn("deviation", 1.4826 * _middle(F.transform("__held", lambda x: F.abs(x - F.col("median")))))
    return held.where(F.abs(F.col(value) - F.col("median")) > k * F.col("deviation")).drop("__held")


def sequences(events: DataFrame, by: list[str], steps: list[str], within: int, ts: str = "ts", ties: list[str] | None = None) -> DataFrame:
    """by, first, last: rows that follow each other in a group and meet the conditions of steps one by one, within so many seconds.

    Groups are cut by time, and each cut also sees what follows it within that time, so a busy
    group is many tasks' work; a row begins a match in one cut only. Of rows of one instant, ties give the order.
    """
    size = max(1, within * 4)
    seconds = _seconds(ts)
    cut = F.floor(seconds / size)
    cuts = F.when(seconds % size <= within, F.array(cut, cut - 1)).otherwise(F.array(cut))
    keys = [f"__s{i}" for i in range(len(steps))]
    rows = events.select(*by, F.col(ts).cast("timestamp").alias("__at"), *(ties or []), *[F.coalesce(F.expr(c), F.lit(False)).alias(k) for c, k in zip(steps, keys, strict=True)], cut.alias("__own"), F.explode(cuts).alias("__cut"))
    order = Window.partitionBy(*by, "__cut").orderBy("__at", *(ties or []))
    meets = F.col(keys[0])
    for i, k in enumerate(keys[1:], 1):
        meets = meets & F.coalesce(F.lead(k, i).over(order), F.lit(False))
    found = rows.withColumns({"__meets": meets, "last": F.lead("__at", len(steps) - 1).over(order)})
    near = F.unix_micros("last") - F.unix_micros("__at") <= within * 1_000_000
    return found.where(F.col("__meets") & (F.col("__own") == F.col("__cut")) & near).select(*by, F.col("__at").alias("first"), "last")
