"""Event time with nothing lost: late rows as an output of their own, sessions under a watermark.

A stream's watermark drops what is behind it without a word. ``split_late`` keeps the mark itself, in
shared storage and by batch: each batch is divided by the mark that the batches before it have left, as
Spark does, rows behind it go to the late sink, and a batch that is delivered again is divided as it was before.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage

Sink = Callable[[DataFrame, int], None]


class Mark:
    """The watermark before each of the last two batches, in microseconds; it never goes back."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def before(self, number: int) -> int | None:
        held = json.loads(storage.get_text(self.spark, self.path) or "{}")
        earlier = [int(n) for n in held if int(n) <= number]
        return held[str(max(earlier))] if earlier else None

    def after(self, number: int, mark: int | None) -> None:
        """What the batches up to number leave to the next one."""
        held = json.loads(storage.get_text(self.spark, self.path) or "{}")
        old = self.before(number)
        new = max((m for m in (old, mark) if m is not None), default=None)
        kept = {n: m for n, m in held.items() if int(n) == number}
        if old is not None:
            kept[str(number)] = old
        if new is not None:
            kept[str(number + 1)] = new
        storage.put_text(self.spark, self.path, json.dumps(kept))


def split_late(sink: Sink, late: Sink, ts: str, mark: Mark, delay: str = "10 minutes") -> Sink:
    """A sink for foreachBatch: rows on time (and rows without a time) go to sink, rows behind the mark to late.

    Both are given every batch under its number, so a repeated one overwrites what it left.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))

    def run(df: DataFrame, number: int) -> None:
        before = mark.before(number)
        is_late = F.coalesce(micros < F.lit(before), F.lit(False)) if before is not None else F.lit(False)
        sink(df.where(~is_late), number)
        late(df.where(is_late), number)
        newest = df.agg(F.unix_micros(F.max(F.col(ts).cast("timestamp")) - F.expr(f"INTERVAL {delay}")).alias("m")).first()["m"]
        mark.after(number, newest)

    return run


def sessions(events: DataFrame, by: list[str], ts: str = "ts", gap: str = "30 minutes", delay: str | None = None) -> DataFrame:
    """by, start, last (the last event's time), events: runs of events no further than gap apart.

    With a delay, under a watermark as a stream in append mode: a session leaves once the watermark has passed its end.
    """
    rows = events.withWatermark(ts, delay) if delay else events
    found = rows.groupBy(*by, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("events"), F.max(ts).alias("last"))
    return found.select(*by, F.col("w.start").alias("start"), "last", "events")
