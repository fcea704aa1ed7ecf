"""Events of each connection in the order of their sequence numbers, as a stream with state of its own.

What comes early waits in the connection's state until its turn. Where a number stays missing until the
clock of arrivals has passed the waiting events by ``gap``, the gap is given up: what waits goes on, and what was
skipped is let through, marked late, if it ever comes. Numbers that came before are dropped, so a
redelivered event leaves once. State is a number and what waits; connections are dealt by Spark. A
connection is one ordered sequence and so one task's work at a time; where order only matters
within tables or keys of it, these are given as keys too and share its load.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "seq bigint, place bigint, late boolean, payload string"


class InOrder(StatefulProcessor):
    def __init__(self, names: list[str], first: int, gap_ms: int) -> None:
        self.names, self.first, self.gap_ms = names, first, gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "next bigint, place bigint, timer bigint")
        self.early = handle.getMapState("early", "seq bigint", "ts bigint, payload string")
        self.skipped = handle.getMapState("skipped", "first bigint", "last bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        next_, place, timer = self.at.get() if self.at.exists() else (self.first, 0, 0)
        gaps = {k[0]: v[0] for k, v in self.skipped.iterator()} if next_ > self.first else {}
        out, waits = [], {}
        for frame in rows:
            for seq, ts, payload in zip(frame["seq"].tolist(), frame["ts_ms"].tolist(), frame["payload"].tolist(), strict=True):
                if seq >= next_:
                    waits.setdefault(seq, (ts, payload))
                elif (hole := next((a for a, b in gaps.items() if a <= seq <= b), None)) is not None:
                    place += 1
                    out.append((seq, place, True, payload))
                    last = gaps.pop(hole)
                    self.skipped.removeKey((hole,))
                    for a, b in ((hole, seq - 1), (seq + 1, last)):
                        if a <= b:
                            gaps[a] = b
                            self.skipped.updateValue((a,), (b,))
        # What continues the sequence leaves at once; only what is early goes into state.
        held = {k[0] for k in self.early.keys()} if self.early.exists() else set()
        while next_ in held or next_ in waits:
            _, payload = waits.pop(next_, None) or self.early.getValue((next_,))
            if next_ in held:
                held.remove(next_)
                self.early.removeKey((next_,))
            place += 1
            out.append((next_, place, False, payload))
            next_ += 1
        for seq in waits.keys() - held:
            self.early.updateValue((seq,), waits[seq])
        self._wait(next_, place, timer, held | waits.keys())
        yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        next_, place, timer = self.at.get()
        mark, out = timerValues.getCurrentWatermarkInMs(), []
        held = sorted((k[0], *v) for k, v in self.early.iterator())
        for seq, ts, payload in held:
            if seq != next_ and ts + self.gap_ms > mark:
                break  # its gap may yet be filled
            if seq != next_:
                self.skipped.updateValue((next_,), (seq - 1,))
            place, next_ = place + 1, seq + 1
            out.append((seq, place, False, payload))
            self.early.removeKey((seq,))
        self._wait(next_, place, 0, {seq for seq, *_ in held if seq >= next_})
        yield self._frame(key, out)

    def _wait(self, next_: int, place: int, timer: int, held: set[int]) -> None:
        """Keeps the place, and a timer for the first event that waits."""
        due = self.early.getValue((min(held),))[0] + self.gap_ms if held else 0
        if due != timer:
            if timer and timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if due:
                self.handle.registerTimer(due)
        self.at.update((next_, place, due))

    def _frame(self, key, rows: list[tuple]) -> pd.DataFrame:
        keys = {name: pd.Series([value] * len(rows), dtype=object) for name, value in zip(self.names, key, strict=True)}
        return pd.DataFrame(keys | {name: pd.Series([r[i] for r in rows], dtype=object) for i, name in enumerate(["seq", "place", "late", "payload"])})

    def close(self) -> None:
        pass


def in_order(events: DataFrame, keys: list[str], seq: str, ts: str, first: int = 1, gap: str = "10 minutes", delay: str = "1 minute") -> DataFrame:
    """keys, seq, place (from 1), late, payload (the event as JSON): each connection's events, numbered as they leave.

    seq counts up from first without gaps but for losses. ts is the time that an event arrived at (in its log, say),
    not its own time: Spark leaves out rows at or before the watermark, so what arrives must be younger than the newest less delay.
    The session needs the RocksDB state store.
    """
    spark = events.sparkSession
    gap_ms = spark.range(1).select((F.unix_micros(F.lit(0).cast("timestamp") + F.expr(f"INTERVAL {gap}")) / 1000).cast("long")).first()[0]
    kinds = dict(events.dtypes)
    rows = events.where(F.col(seq).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, delay)
    narrow = rows.select(*keys, F.col(seq).cast("long").alias("seq"), F.unix_millis(ts).alias("ts_ms"), F.to_json(F.struct(*[c for c in events.columns])).alias("payload"), F.col(ts).alias("__ts"))
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", " + OUT
    return narrow.groupBy(*keys).transformWithStateInPandas(InOrder(keys, first, gap_ms), schema, "append", "EventTime")
