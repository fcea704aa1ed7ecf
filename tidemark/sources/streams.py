"""Keyed event logs as a stream source with consumer groups.

A log is a folder with a subfolder for each key, whose files hold consecutive lines and say so in their names:
first position and number of lines. ``publish`` appends to it as a Spark job. ``LogSource`` reads it as a
stream: offsets are positions by key, a partition is a range of one key's positions, and only the names of
files pass through the driver. Batches are released by count or time, key by key.

A consumer group is a file in the log that holds, by key, where the group began, what was delivered and what
is acknowledged. It is written when the group first asks (at the log's end for ``latest``), so a
query that stops before its first batch finds its place again; Spark's commit of a batch, which comes with the next one, acknowledges it. A query
with a new checkpoint begins where its group has acknowledged. One query at a time uses a group.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..operators.sweep import positions
from .clean import whole_json

#: Lines of a file of a log, and positions that a partition of a stream reads, at most.
SEGMENT, RANGE = 10_000, 50_000
_SCHEMA = "key string, position bigint, line string"


def opened(root: str) -> tuple[pafs.FileSystem, str]:
    """The file system that a folder is in, and its path there."""
    return pafs.FileSystem.from_uri(root) if ":" in root.split("/")[0] else (pafs.LocalFileSystem(), root)


def _files(root: str, key: str) -> list[tuple[int, int, str]]:
    """(first, end, path) of a key's files, in order."""
    system, path = opened(root)
    found = []
    for f in system.get_file_info(pafs.FileSelector(f"{path}/{key}", allow_not_found=True)):
        name = f.base_name.removesuffix(".log")
        if f.base_name.endswith(".log"):
            first, count = map(int, name.split("-"))
            found.append((first, first + count, f.path))
    return sorted(found)


def ends(root: str, keys: list[str]) -> dict[str, int]:
    """The position after each key's last line."""
    return {k: max((x[1] for x in _files(root, k)), default=0) for k in keys}


def _put(root: str, name: str, data: bytes) -> None:
    """Writes a file under another name and moves it into place, so that no reader sees a part of it."""
    system, path = opened(root)
    system.create_dir(f"{path}/{name}".rpartition("/")[0], recursive=True)
    part = f"{path}/{name}.part-{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(data)
    system.move(part, f"{path}/{name}")


def _get(root: str, name: str) -> bytes | None:
    system, path = opened(root)
    if system.get_file_info(f"{path}/{name}").type == pafs.FileType.NotFound:
        return None
    with system.open_input_stream(f"{path}/{name}") as f:
        return f.read()


def publish(rows: DataFrame, root: str, key: str, line: str, order: str, segment: int | None = None) -> None:
    """Appends lines to the logs of their keys, in an order within each key.

    A task writes one file, of segment lines of one key at most; a retry writes the same one again.
    """
    size = segment or SEGMENT
    placed = positions(rows.select(F.col(key).cast("string").alias("key"), F.col(line).alias("line"), F.col(order).alias("order")), ["key"], "order")
    counts = placed.groupBy("key").agg(F.max("size").alias("n"))
    at = ends(root, [r.key for r in counts.select("key").collect()])  # a row a key: the keys are the source's connections
    begin = F.create_map(*[x for k, n in at.items() for x in (F.lit(k), F.lit(n).cast("long"))]) if at else F.lit(None).cast("map<string,bigint>")

    def write(group: tuple, table: pa.Table) -> pa.Table:
        lines = table.sort_by("position")
        first = lines.column("position")[0].as_py()
        text = "".join(x.replace("\n", " ") + "\n" for x in lines.column("line").to_pylist())
        _put(root, f"{group[0].as_py()}/{first:020}-{lines.num_rows}.log", text.encode())
        return pa.table({"n": [lines.num_rows]})

    number = F.col("position") - 1
    dealt = placed.select("key", F.floor(number / size).alias("segment"), (number + begin[F.col("key")]).alias("position"), F.coalesce("line", F.lit("")).alias("line"))
    dealt.groupBy("key", "segment").applyInArrow(write, "n bigint").agg(F.sum("n")).collect()


class Group:
    """What a consumer group holds of each key: begin, delivered and acked positions."""

    def __init__(self, root: str, name: str) -> None:
        self.root, self.file = root, f"_groups/{name}.json"

    def read(self) -> dict[str, dict[str, int]]:
        held = _get(self.root, self.file)
        return json.loads(held) if held else {}

    def update(self, what: str, at: dict[str, int]) -> None:
        """Moves positions forward, never back."""
        held = self.read()
        for k, n in at.items():
            own = held.setdefault(k, {})
            own[what] = max(int(n), own.get(what, 0))
        _put(self.root, self.file, json.dumps(held, sort_keys=True).encode())

    def ensure(self, keys: list[str], start: str) -> dict[str, int]:
        """Where each key is to be read from: what the group has acknowledged, else where it began; keys new to it begin now."""
        held = self.read()
        new = [k for k in keys if k not in held]
        if new:
            self.update("begin", ends(self.root, new) if start == "latest" else dict.fromkeys(new, 0))
            held = self.read()
        return {k: held[k].get("acked", held[k]["begin"]) for k in keys}

    def pending(self, keys: list[str]) -> int:
        """Lines that were delivered but not acknowledged."""
        held = self.read()
        return sum(max(0, held[k].get("delivered", 0) - held[k].get("acked", held[k]["begin"])) for k in keys if k in held and "delivered" in held[k])


def groups(root: str) -> list[str]:
    """The consumer groups of a log."""
    system, path = opened(root)
    found = system.get_file_info(pafs.FileSelector(f"{path}/_groups", allow_not_found=True))
    return sorted(f.base_name.removesuffix(".json") for f in found if f.base_name.endswith(".json"))


def trim(root: str, keys: list[str]) -> int:
    """Deletes files whose lines all groups have acknowledged (none, without a group), but for each key's last one, which says where it ends. Returns how many.

    A group that is new later on begins with the lines that are left.
    """
    system, _ = opened(root)
    held = [Group(root, g).read() for g in groups(root)]
    gone = 0
    for key in keys:
        places = [h[key].get("acked", h[key]["begin"]) for h in held if key in h]
        for _, end, path in _files(root, key)[:-1]:
            if places and end <= min(places):
                system.delete_file(path)
                gone += 1
    return gone


class KeyRange(InputPartition):
    def __init__(self, key: str, start: int, end: int) -> None:
        self.key, self.start, self.end = key, start, end


class LogReader(DataSourceStreamReader):
    """Offsets are {key: position}. max_events and max_wait: a key's lines are released once there are so many or the first has waited so long."""

    def __init__(self, root: str, keys: list[str], group: str, start: str = "latest", max_events: int = 0, max_wait: float = 0.0, clock: Callable[[], float] = time.time) -> None:
        self.root, self.keys, self.group, self.start = root, keys, Group(root, group), start
        self.max_events, self.max_wait, self.clock = max_events, max_wait, clock
        self.at: dict[str, int] = {}
        self.seen: dict[str, float] = {}

    def initialOffset(self) -> dict:
        self.at = self.group.ensure(self.keys, self.start)
        return dict(self.at)

    def latestOffset(self) -> dict:
        if set(self.keys) - set(self.at):  # a query that goes on: what it was given, as its checkpoint also says
            held, begin = self.group.read(), self.group.ensure(self.keys, self.start)
            self.at = {k: max(self.at.get(k, 0), held.get(k, {}).get("delivered", begin[k])) for k in self.keys}
        now = self.clock()
        for k, end in ends(self.root, self.keys).items():
            ready = end - self.at[k]
            if ready <= 0:
                self.seen.pop(k, None)
                continue
            since = self.seen.setdefault(k, now)
            if not self.max_events:
                self.at[k] = end
            elif ready >= self.max_events:
                self.at[k] += self.max_events
                self.seen.pop(k)
            elif now - since >= self.max_wait:
                self.at[k] = end
                self.seen.pop(k)
        return dict(self.at)

    def partitions(self, start: dict, end: dict) -> list[KeyRange]:
        self.at |= {k: max(n, self.at.get(k, 0)) for k, n in end.items()}
        self.group.update("delivered", end)
        begin = {k: start.get(k, 0) if k in start else self.group.ensure([k], self.start)[k] for k in end}
        return [KeyRange(k, a, min(a + RANGE, n)) for k, n in end.items() for a in range(begin[k], n, RANGE)]

    def read(self, partition: KeyRange) -> Iterator[tuple]:
        for first, end, path in _files(self.root, partition.key):
            if first < partition.end and end > partition.start:
                system, _ = opened(self.root)
                with system.open_input_stream(path) as f:
                    lines = f.read().decode(errors="replace").split("\n")
                for position in range(max(first, partition.start), min(end, partition.end)):
                    yield partition.key, position, lines[position - first]

    def commit(self, end: dict) -> None:
        self.group.update("acked", end)


class LogSource(DataSource):
    """Options: path, keys (comma-separated), group, start (latest or earliest), maxEvents, maxWaitSeconds."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_log"

    def schema(self) -> str:
        return _SCHEMA

    def streamReader(self, schema) -> LogReader:
        o = self.options
        if o.get("start", "latest") not in ("latest", "earliest"):
            raise ValueError(f"start must be latest or earliest, not {o['start']!r}")
        return LogReader(o["path"], [k for k in o["keys"].split(",") if k], o.get("group", "default"), o.get("start", "latest"), int(o.get("maxEvents", 0)), float(o.get("maxWaitSeconds", 60)))


def log_stream(spark: SparkSession, root: str, keys: list[str], group: str, start: str = "latest", max_events: int | None = None, max_wait: float = 60.0) -> DataFrame:
    """key, position, line of the logs of keys as a stream, for a consumer group.

    A group that is new begins at start. With max_events, each batch takes so many lines of a
    key, or what there is once the first of them has waited max_wait seconds.
    """
    spark.dataSource.register(LogSource)
    options = {"path": root, "keys": ",".join(keys), "group": group, "start": start} | ({"maxEvents": str(max_events), "maxWaitSeconds": str(max_wait)} if max_events else {})
    return spark.readStream.format("tidemark_log").options(**options).load()


def decoded(lines: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """Lines as key, position and their fields; and the lines that are no JSON objects of any of the fields, which are skipped and not read again."""
    event = F.from_json("line", schema)
    known = whole_json(F.col("line")) & F.coalesce(F.size(F.json_object_keys("line")) > 0, F.lit(False))
    marked = lines.withColumn("__known", known)
    return marked.where("__known").select("key", "position", event.alias("e")).select("key", "position", "e.*"), marked.where("NOT __known").select("key", "position", "line")
