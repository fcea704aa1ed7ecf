"""Deliveries that survive crashes: how often a batch was handed over is kept beside the checkpoint.

Spark hands a batch over again after a restart, under its number, until the sink has returned. ``durable`` counts these
deliveries in shared storage before each one, so that a batch that brings the query down every time is set
aside once its budget is spent, in whatever session that is. ``supervised`` starts a query that failed
again, after pauses that double and are spread by chance, so that many queries do not come back at once.
"""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..operators import quality

#: Deliveries of a batch, and the spread of pauses (fixed values).
BUDGET, SPREAD = 10, (0.5, 1.5)

Sink = Callable[[DataFrame, int], None]


def pause(attempt: int, base: float = 1.0, most: float = 60.0, chance: Callable[[], float] = random.random) -> float:
    """Seconds before an attempt (from 0): doubled each time up to most, times 0.5 to 1.5."""
    low, high = SPREAD
    return min(most, base * 2**attempt) * (low + (high - low) * chance())


class Attempts:
    """Deliveries of batches that have not succeeded yet: a file a batch, below a folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def _file(self, number: int) -> str:
        return f"{self.folder}/batch-{number}.json"

    def of(self, number: int) -> dict:
        held = storage.get_text(self.spark, self._file(number))
        return json.loads(held) if held else {"deliveries": 0, "reason": None}

    def begin(self, number: int) -> int:
        """Counts a delivery before it is made; returns which one it is, from 1."""
        held = self.of(number)
        held["deliveries"] += 1
        storage.put_text(self.spark, self._file(number), json.dumps(held))
        return held["deliveries"]

    def failed(self, number: int, reason: str) -> None:
        storage.put_text(self.spark, self._file(number), json.dumps(self.of(number) | {"reason": reason[:2000]}))

    def done(self, number: int) -> None:
        storage.delete(self.spark, self._file(number))

    def pending(self) -> dict[int, int]:
        """Deliveries so far of the batches that are still out."""
        names = [f.rpartition("/")[2] for f in storage.files(self.spark, self.folder)]
        numbers = [int(n.removeprefix("batch-").removesuffix(".json")) for n in names if n.endswith(".json")]
        return {n: self.of(n)["deliveries"] for n in numbers}


def durable(sink: Sink, attempts: Attempts, dead_letters: str, budget: int = BUDGET) -> Sink:
    """A sink whose batch goes to the dead letters, with the last reason, once it has been delivered budget times in vain.

    Any failure of the sink ends the query; Spark delivers the batch again when it is next started.
    """

    def run(df: DataFrame, number: int) -> None:
        if attempts.begin(number) > budget:
            reason = f"retry budget exhausted: {attempts.of(number)['reason'] or 'the query ended without an error'}"[:2000]
            letters = quality.quarantined(df, str(number)).withColumns({"reason": F.lit(reason), "deliveries": F.lit(budget)})
            letters.write.mode("overwrite").parquet(f"{dead_letters}/batch={number}")
        else:
            try:
                sink(df, number)
            except Exception as e:
                attempts.failed(number, str(e))
                raise
        attempts.done(number)

    return run


def supervised(build: Callable[[], object], restarts: int = 100, base: float = 1.0, most: float = 60.0, sleep: Callable[[float], None] = time.sleep, chance: Callable[[], float] = random.random) -> int:
    """Runs the query that build starts until it ends by itself; returns how often it had to be started again.

    The pause begins anew once a query has got further than the one before.
    """
    failures, at = 0, -1
    for started in range(restarts + 1):
        query = build()
        try:
            query.awaitTermination()
            return started
        except Exception:
            reached = (query.lastProgress or {}).get("batchId", -1)
            failures, at = (0 if reached > at else failures + 1), max(at, reached)
            if started == restarts:
                raise
            sleep(pause(failures, base, most, chance))
    raise AssertionError("not reached")
