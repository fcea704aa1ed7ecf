"""Micro-batches through the batch operators: decode, transform, check, apply, quarantine."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..operators import metrics, quality
from ..plans import pipeline
from ..storage import scratch
from . import delivery

__all__ = ["scratch"]

#: Fields of a line of an event log.
EVENT = "op string, pk string, before string, after string, ts_ms bigint"


def file_events(spark: SparkSession, path: str, schema, max_files: int | None = None, glob: str = "*.parquet") -> DataFrame:
    """The Parquet files of a folder whose names fit glob, as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)


def started(spark: SparkSession, checkpoint: str) -> datetime:
    """When a query with this checkpoint was first started; written beside it then, and read from there ever after."""
    held = storage.get_text(spark, f"{checkpoint}.started")
    if held is None:
        held = datetime.now().astimezone().isoformat()
        storage.put_text(spark, f"{checkpoint}.started", held)
    return datetime.fromisoformat(held)


def log_events(spark: SparkSession, folder: str, starting: str | datetime = "earliest", max_files: int | None = None, checkpoint: str | None = None) -> DataFrame:
    """The lines of a folder of JSON event logs as a stream: the event's fields, and line for one that is no event.

    starting: earliest, latest (files that come after the query's first start, which needs its checkpoint to find
    that again) or a time. Spark plans the files and their splits, and its checkpoint says which were read.
    """
    if starting == "latest" and checkpoint is None:
        raise ValueError("latest needs the checkpoint, beside which the first start is kept")
    reader = spark.readStream
    lines = (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).text(folder)
    if starting != "earliest":
        since = started(spark, checkpoint) if starting == "latest" else starting
        lines = lines.where(F.col("_metadata.file_modification_time") >= F.lit(since))
    event = F.from_json("value", EVENT)
    known = F.try_parse_json("value").isNotNull() & event["op"].isNotNull()
    return lines.select(F.when(known, event).alias("e"), F.when(~known, F.col("value")).alias("line")).select("e.*", "line")


def deduplicated(events: DataFrame, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Each event id once within the delay; what comes later is applied again, harmlessly by key."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["event_id"])


def rates(events: DataFrame, ts: str = "ts", size: str = "5 minutes", delay: str = "10 minutes", by: list[str] | None = None) -> DataFrame:
    """Events a second in windows of event time; events later than the delay are left out."""
    return metrics.rate(events.withWatermark(ts, delay), ts, size, by=by)


def to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Takes what is available and writes the rows that it adds."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def updates_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Takes what is available and writes the groups that each batch changes, under the batch's number."""
    batch = lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{path}/part={n}")
    stream.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def newest_updates(table: DataFrame, keys: list[str]) -> DataFrame:
    """Of the groups that batches wrote, each as the last one left it."""
    return metrics.latest_of(table, keys, ["batch"], [c for c in table.columns if c not in (*keys, "batch", "part")])


def retried(sink: Callable[[DataFrame, int], None], attempts: int = 3, pause: float = 1.0, most: float = 60.0, dead_letters: str | None = None, sleep: Callable[[float], None] = time.sleep, chance: Callable[[], float] | None = None) -> Callable[[DataFrame, int], None]:
    """A sink that is tried again after a pause that doubles up to most seconds, spread by chance. A batch that fails every
    time goes to the dead letters with the reason, under its number; without them the error is raised.

    Attempts count within one session; ``delivery.durable`` counts across crashes.
    """

    def run(df: DataFrame, number: int) -> None:
        df.persist()
        try:
            for i in range(attempts):
                try:
                    return sink(df, number)
                except Exception as e:  # noqa: BLE001
                    if i + 1 == attempts:
                        if dead_letters is None:
                            raise
                        reason = f"retry budget exhausted: {e}"[:2000]
                    else:
                        sleep(delivery.pause(i, pause, most, **({"chance": chance} if chance else {})))
            quality.quarantined(df, str(number)).withColumn("reason", F.lit(reason)).write.mode("overwrite").parquet(f"{dead_letters}/batch={number}")
        finally:
            df.unpersist()

    return run


def start(events: DataFrame, spec: dict | Callable[[], dict], policy: dict | None, sink: Callable[[DataFrame, int], None], checkpoint: str, dead_letters: str | None = None, every: str | None = None):
    """Runs the query; without every it takes what is available and stops.

    spec may be a function, read again each batch, so that a changed pipeline takes effect. The
    sink and the dead letters are written under the batch's number: a replayed batch overwrites.
    With dead letters, rows whose JSON the pipeline's steps can't read go there too. A batch's rows are kept
    while they are divided, so the pipeline runs over them once.
    """

    def batch(df: DataFrame, number: int) -> None:
        steps = spec() if callable(spec) else spec
        columns = pipeline.json_columns(steps) if dead_letters else []
        good, bad = pipeline.split_json(df, [c for c in columns if c in df.columns]) if columns else (df, None)
        rows = pipeline.run(good, steps).rows
        if bad is not None:
            quality.quarantined(bad, str(number)).withColumn("reason", F.lit("no JSON")).write.mode("overwrite").parquet(f"{dead_letters}/kind=json/batch={number}")
        if policy is None:
            return sink(rows, number)
        rows = rows.persist()
        try:
            found = quality.apply(rows, policy)
            sink(found.passed, number)
            if dead_letters:
                quality.quarantined(found.failed, str(number)).write.mode("overwrite").parquet(f"{dead_letters}/kind=rules/batch={number}")
        finally:
            rows.unpersist()

    out = events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return out.trigger(**({"processingTime": every} if every else {"availableNow": True})).start()
