"""Queries over streams, stored tables and rules over time, each with the SQL that it must agree with.

Streams read what Spark writes from the test tables first: logs by key, or files in an order of arrival. Where a query
stops and starts again, it does so on one checkpoint, as a crashed one would.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import storage
from ..operators import alerts as metrics_alerts
from ..operators import apply, changes, metrics, quality, ranges, schemas
from ..sources import logs, streams
from ..streaming import delivery, eventtime, ordered, runner
from . import pipeline
from .catalog import BASE, LOG, Tables, base, case, columns_of, log, usage, usage_rows

#: Event types, which are the keys of the logs (fixed values of the test data).
TYPES = ["click", "error", "purchase", "signup", "view"]


def stamped(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


# -- logs by key, with groups --------------------------------------------------------------------
_EVENT = "event_id bigint, user_id bigint, value double"


def _lines(events: DataFrame) -> DataFrame:
    return events.select("event_type", "event_id", F.to_json(F.struct("event_id", "user_id", "value")).alias("line"))


def _read(t: Tables, root: str, out: str, group: str, start: str, **more) -> None:
    """Takes what the group has not had yet, and stops."""
    spark = t("events").sparkSession
    lines = streams.log_stream(spark, root, TYPES, group, start, **more)
    runner.to_table(streams.decoded(lines, _EVENT)[0], out, f"{out}-checkpoint")


@case("stream_log", "SELECT event_type AS key, event_id, user_id, value FROM events")
def stream_log(t: Tables) -> DataFrame:
    """Half of the events, a stop, the rest with entries that are no events, a restart: nothing is lost or read twice."""
    events, spark = t("events"), t("events").sparkSession
    root = storage.scratch(spark, "log")
    streams.publish(_lines(events.where("event_id % 2 = 0")), root, "event_type", "line", "event_id", 2000)
    _read(t, root, f"{root}-out", "g", "earliest")
    broken = _lines(events.where("event_id % 7 = 1")).withColumn("line", F.concat(F.lit("{"), "line"))
    streams.publish(_lines(events.where("event_id % 2 = 1")).unionByName(broken), root, "event_type", "line", "event_id", 2000)
    _read(t, root, f"{root}-out", "g", "earliest")
    _read(t, root, f"{root}-out", "g", "earliest")
    return spark.read.schema(f"key string, position bigint, {_EVENT}").parquet(f"{root}-out").drop("position")


@case("stream_log_latest", "SELECT event_type AS key, event_id FROM events WHERE event_id % 2 = 1")
def stream_log_latest(t: Tables) -> DataFrame:
    """A group that begins at the end, stops before anything comes, and finds its place again though it never had a batch."""
    events, spark = t("events"), t("events").sparkSession
    root = storage.scratch(spark, "log")
    streams.publish(_lines(events.where("event_id % 2 = 0")), root, "event_type", "line", "event_id")
    _read(t, root, f"{root}-out", "g", "latest")
    streams.publish(_lines(events.where("event_id % 2 = 1")), root, "event_type", "line", "event_id")
    _read(t, root, f"{root}-out", "g", "latest")
    return spark.read.schema(f"key string, position bigint, {_EVENT}").parquet(f"{root}-out").select("key", "event_id")


@case("stream_log_ack", "SELECT event_type AS key, count(*) FILTER (event_id % 2 = 0) AS acked, CAST(count(*) FILTER (event_id % 2 = 1) AS INTEGER) AS pending FROM events GROUP BY 1")
def stream_log_ack(t: Tables) -> DataFrame:
    """What a group has acknowledged of each key, and what it was given but has not: Spark commits a batch with the next one."""
    events, spark = t("events"), t("events").sparkSession
    root = storage.scratch(spark, "log")
    for i in range(2):
        streams.publish(_lines(events.where(f"event_id % 2 = {i}")), root, "event_type", "line", "event_id")
        _read(t, root, f"{root}-out", "g", "earliest")
    held = streams.Group(root, "g").read()
    rows = [(k, held[k].get("acked", 0), streams.Group(root, "g").pending([k])) for k in sorted(held)]
    return spark.createDataFrame(rows, "key string, acked bigint, pending int")


# -- order, redelivery, late rows ----------------------------------------------------------------
def _arrivals(df: DataFrame, path: str, batch: str, batches: int) -> None:
    """Files that arrive one after another: batch numbers the one that a row is in."""
    for i in range(batches):
        df.where(F.expr(batch) == i).coalesce(1).write.mode("append").parquet(path)


_SEQ = "(SELECT user_id, event_id, seq FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events WHERE user_id IS NOT NULL) WHERE seq % 10 <> 7)"


@case("stream_ordered", f"SELECT user_id, seq, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS place, event_id FROM {_SEQ}")
def stream_ordered(t: Tables) -> DataFrame:
    """Events that arrive in no order, some twice and some never, leave in order by connection; lost ones are waited for and given up."""
    spark = t("events").sparkSession
    path = storage.scratch(spark, "ordered")
    numbered = metrics.positions(t("events").where("user_id IS NOT NULL").select("user_id", "event_id"), ["user_id"], "event_id").withColumnRenamed("position", "seq").drop("size")
    arrived = lambda n: F.timestamp_seconds(F.lit(n))
    known = numbered.where("seq % 10 <> 7").withColumn("batch", F.pmod(F.xxhash64("event_id"), F.lit(3)).cast("int"))
    again = known.where("event_id % 11 = 0").withColumn("batch", (F.col("batch") + 1) % 3)
    rows = known.unionByName(again).withColumn("arrived", F.timestamp_seconds(F.col("batch") * 10 + 1_700_000_000))
    # The clock goes on when something arrives, of another connection here: gaps are given up, and then those behind them.
    clock = [spark.range(1).select(F.lit(-1).cast("long").alias("user_id"), F.lit(0).cast("long").alias("event_id"), F.lit(i + 1).cast("long").alias("seq"), F.lit(3 + i).alias("batch"), arrived(1_700_000_000 + 10_000 * (i + 1)).alias("arrived")) for i in range(2)]
    for c in clock:
        rows = rows.unionByName(c)
    _arrivals(storage.written(rows, "arrivals"), f"{path}-in", "batch", 5)
    source = runner.file_events(spark, f"{path}-in", "user_id bigint, event_id bigint, seq bigint, arrived timestamp", 1)
    with storage.settings(spark, {"spark.sql.streaming.stateStore.providerClass": ordered.ROCKSDB}):
        runner.to_table(ordered.in_order(source, ["user_id"], "seq", "arrived", gap="1 hour"), path, f"{path}-checkpoint")
    found = spark.read.schema("user_id bigint, seq bigint, place bigint, late boolean, payload string").parquet(path)
    return found.where("user_id >= 0").select("user_id", "seq", "place", F.get_json_object("payload", "$.event_id").cast("bigint").alias("event_id"))


@case("stream_redelivery", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'dead' ELSE 'kept' END AS state, CASE WHEN event_type = 'error' THEN 10 END AS deliveries FROM events")
def stream_redelivery(t: Tables) -> DataFrame:
    """A batch that brings the query down every time is delivered ten times, over as many starts; the eleventh sets it aside."""
    spark = t("events").sparkSession
    path = storage.scratch(spark, "delivery")
    _arrivals(t("events").select("event_id", "event_type"), f"{path}-in", "CASE WHEN event_type = 'error' THEN 1 WHEN event_id % 2 = 0 THEN 0 ELSE 2 END", 3)
    source = runner.file_events(spark, f"{path}-in", "event_id bigint, event_type string", 1)

    def sink(df: DataFrame, number: int) -> None:
        if not df.where("event_type = 'error'").isEmpty():
            raise OSError("a sink that can't take this batch")
        df.write.mode("overwrite").parquet(f"{path}/batch={number}")

    def build():
        attempts = delivery.Attempts(spark, f"{path}-attempts")  # as a new session finds them
        out = source.writeStream.foreachBatch(delivery.durable(sink, attempts, f"{path}-dead")).option("checkpointLocation", f"{path}-checkpoint")
        return out.trigger(availableNow=True).start()

    delivery.supervised(build, sleep=lambda _: None)
    kept = spark.read.parquet(path).select("event_id", F.lit("kept").alias("state"), F.lit(None).cast("int").alias("deliveries"))
    dead = spark.read.parquet(f"{path}-dead").select(F.get_json_object("row", "$.event_id").cast("bigint").alias("event_id"), F.lit("dead").alias("state"), "deliveries")
    return kept.unionByName(dead)


_WINDOWS = "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, event_type, count(*) AS events FROM events WHERE {} GROUP BY 1, 2"


@case("stream_late", f"SELECT *, 'on time' AS part FROM ({_WINDOWS.format('event_id % 9 <> 0')}) UNION ALL SELECT *, 'late' FROM ({_WINDOWS.format('event_id % 9 = 0')})")
def stream_late(t: Tables) -> DataFrame:
    """Rows behind the watermark come out beside those on time: both together are the batch query."""
    spark = t("events").sparkSession
    path = storage.scratch(spark, "late")
    events = stamped(t("events")).select("event_id", "event_type", "ts")
    last = events.agg(F.max("ts").alias("last"))
    # A ninth of the events arrives after one that is a day ahead of them all.
    ahead = last.select(F.lit(-1).cast("long").alias("event_id"), F.lit("clock").alias("event_type"), (F.col("last") + F.expr("INTERVAL 1 DAY")).alias("ts"))
    _arrivals(events.unionByName(ahead), f"{path}-in", "CASE WHEN event_type = 'clock' THEN 1 WHEN event_id % 9 = 0 THEN 2 ELSE 0 END", 3)
    source = runner.file_events(spark, f"{path}-in", "event_id bigint, event_type string, ts timestamp", 1)
    into = lambda name: lambda df, n: df.write.mode("overwrite").parquet(f"{path}/part={name}/batch={n}")
    sink = eventtime.split_late(into("on time"), into("late"), "ts", eventtime.Mark(spark, f"{path}-mark.json"))
    source.writeStream.foreachBatch(sink).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema("event_id bigint, event_type string, ts timestamp, part string").parquet(path).where("event_type <> 'clock'")
    return found.groupBy(F.window("ts", "5 minutes").alias("w"), "event_type", "part").agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), "event_type", "events", "part")


@case("stream_sessions", "SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS events FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WHERE user_id IS NOT NULL)) GROUP BY user_id, s")
def stream_sessions(t: Tables) -> DataFrame:
    """Sessions as a stream: each leaves once, when the watermark has passed it."""
    spark = t("events").sparkSession
    path = storage.scratch(spark, "sessions")
    events = stamped(t("events")).where("user_id IS NOT NULL").select("user_id", "ts")
    middle, last = events.agg(F.percentile_approx("ts", 0.5).alias("m"), F.max("ts").alias("l")).first()
    end = spark.createDataFrame([(-1, last + timedelta(days=2)), (-2, last + timedelta(days=4))], "user_id bigint, ts timestamp")
    _arrivals(events.unionByName(end), f"{path}-in", f"CASE WHEN user_id = -2 THEN 3 WHEN user_id = -1 THEN 2 WHEN ts > TIMESTAMP '{middle}' THEN 1 ELSE 0 END", 4)
    source = runner.file_events(spark, f"{path}-in", "user_id bigint, ts timestamp", 1)
    runner.to_table(eventtime.sessions(source, ["user_id"], delay="1 hour"), path, f"{path}-checkpoint")
    return spark.read.schema("user_id bigint, start timestamp, last timestamp, events bigint").parquet(path).where("user_id >= 0")


# -- ranges of keys ------------------------------------------------------------------------------
_COMMITTED = "(SELECT l_orderkey // 500 AS path, min(l_partkey) AS lo, min(l_partkey) + 40 AS hi FROM lineitem WHERE (l_orderkey // 500) % 2 = 0 GROUP BY 1)"
_INCOMING = "(SELECT l_suppkey + 1000000 AS path, CASE WHEN l_suppkey % 17 = 0 THEN NULL ELSE min(l_partkey) * 7 END AS lo, CASE WHEN l_suppkey % 19 = 0 THEN NULL ELSE min(l_partkey) * 7 + l_suppkey % 30 + 1 END AS hi FROM lineitem GROUP BY l_suppkey)"


def committed_files(t: Tables) -> DataFrame:
    return t("lineitem").where("l_orderkey div 500 % 2 = 0").groupBy(F.expr("l_orderkey div 500").alias("path")).agg(F.min("l_partkey").alias("lo"), (F.min("l_partkey") + 40).alias("hi"))


def incoming_files(t: Tables) -> DataFrame:
    n = F.col("l_suppkey")
    files = t("lineitem").groupBy("l_suppkey").agg((F.min("l_partkey") * 7).alias("m"))
    return files.select((n + 1000000).alias("path"), F.when(n % 17 != 0, F.col("m")).alias("lo"), F.when(n % 19 != 0, F.col("m") + n % 30 + 1).alias("hi"))


case("range_admit", f"""WITH c AS (SELECT path, coalesce(lo, -1e18::DOUBLE) AS lo, coalesce(hi, 1e18::DOUBLE) AS hi FROM {_COMMITTED}),
n AS (SELECT path, lo AS a, hi AS b, coalesce(lo, -1e18::DOUBLE) AS lo, coalesce(hi, 1e18::DOUBLE) AS hi FROM {_INCOMING}),
k AS (SELECT * FROM n WHERE a IS NOT NULL OR b IS NOT NULL),
s AS (SELECT * FROM k x WHERE NOT EXISTS (SELECT 1 FROM k y WHERE y.path <> x.path AND y.lo <= x.lo AND y.hi >= x.hi AND (y.lo < x.lo OR y.hi > x.hi OR y.path < x.path))),
j AS (SELECT x.path, EXISTS (SELECT 1 FROM c WHERE c.lo <= x.lo AND c.hi >= x.hi) AS inside, EXISTS (SELECT 1 FROM c WHERE c.lo < x.hi AND x.lo < c.hi) OR EXISTS (SELECT 1 FROM s y WHERE y.lo < x.lo AND y.hi > x.lo) AS meets FROM s x)
SELECT n.path, CASE WHEN a IS NULL AND b IS NULL THEN 'add' WHEN j.path IS NULL OR inside THEN 'skip' WHEN meets THEN 'dedup' ELSE 'add' END AS action FROM n LEFT JOIN j USING (path)""")(lambda t: ranges.admit(committed_files(t), incoming_files(t)).select("path", "action"))


#: Files of a batch: path, the hundredths of the key space that it covers (low, high], its number.
_BATCH = [("a", 10, 40, 1), ("b", 35, 60, 2), ("c", 15, 30, 3), ("d", 80, 90, 4)]


@case("range_replace", f"""WITH m AS (SELECT max(o_orderkey) AS m FROM orders), f AS (SELECT path, m * a // 100 AS lo, m * z // 100 AS hi, n FROM m, (VALUES {', '.join(map(str, _BATCH))}) v(path, a, z, n) WHERE path <> 'c'),
new AS (SELECT o_orderkey, n AS version, row_number() OVER (PARTITION BY o_orderkey ORDER BY lo DESC) AS rn FROM orders JOIN f ON o_orderkey > lo AND o_orderkey <= hi WHERE o_orderkey % 3 = 0)
SELECT o_orderkey, 0 AS version FROM orders WHERE NOT EXISTS (SELECT 1 FROM f WHERE o_orderkey > lo AND o_orderkey <= hi)
UNION ALL SELECT o_orderkey, version FROM new WHERE rn = 1""")
def range_replace(t: Tables) -> DataFrame:
    """Files that overlap what is stored replace it: their ranges are deleted from the table, then their rows are added."""
    spark = t("orders").sparkSession
    most = t("orders").agg(F.max("o_orderkey")).first()[0]
    incoming = spark.createDataFrame([(path, most * a // 100, most * z // 100, n) for path, a, z, n in _BATCH], "path string, lo bigint, hi bigint, version int")
    # The last file's keys are new; one stored file overlaps a and b in part, and c lies in a.
    fresh = incoming.where("path = 'd'").select(F.col("lo").alias("__lo"), F.col("hi").alias("__hi"))
    table = t("orders").join(F.broadcast(fresh), (F.col("o_orderkey") > F.col("__lo")) & (F.col("o_orderkey") <= F.col("__hi")), "left_anti").select("o_orderkey", F.lit(0).alias("version"))
    plan = ranges.admit(spark.createDataFrame([("old", most * 20 // 100, most * 50 // 100)], "path string, lo bigint, hi bigint"), incoming)
    rows = t("orders").where("o_orderkey % 3 = 0").join(F.broadcast(incoming), (F.col("o_orderkey") > F.col("lo")) & (F.col("o_orderkey") <= F.col("hi"))).select("o_orderkey", "version", "path")
    return ranges.replaced(table, rows, plan, "o_orderkey")


# -- stored tables -------------------------------------------------------------------------------
@case("compact_partitions", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, true AS fewer, true AS large_stay, true AS folders_stay FROM orders GROUP BY 1")
def compact_partitions(t: Tables) -> DataFrame:
    """Small files of each partition become one; its folder and its large files stay."""
    spark = t("orders").sparkSession
    path = storage.scratch(spark, "compact")
    rows = t("orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    rows.where("o_orderkey % 2 = 0").repartition(1).write.partitionBy("o_orderstatus").parquet(path)
    rows.where("o_orderkey % 2 = 1").repartition(6).write.mode("append").partitionBy("o_orderstatus").parquet(path)
    before = storage.files(spark, path)
    target = max(before.values())
    large = {f for f, size in before.items() if size * 4 >= target * 3}
    done = apply.compact(spark, path, target)
    after = storage.files(spark, path)
    folders = lambda held: {f.rpartition("/")[0] for f in held}
    flags = {"fewer": done["after"] < done["before"], "large_stay": large <= set(after), "folders_stay": folders(before) == folders(after)}
    found = spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return found.withColumns({k: F.lit(v) for k, v in flags.items()})


@case("ledger_bucketed", "SELECT event_id FROM events WHERE event_id % 4 <> 0")
def ledger_bucketed(t: Tables) -> DataFrame:
    """Events that a bucketed ledger does not hold: only the batch is exchanged."""
    spark, name = t("events").sparkSession, f"ledger_{uuid.uuid4().hex}"
    ledger = apply.bucketed(t("events").where("event_id % 4 = 0").select("event_id"), name, ["event_id"], 8)
    batch = t("events").unionByName(t("events").where("event_id < 100"))
    fresh = storage.written(changes.unapplied(batch, ledger).select("event_id"), "fresh")
    apply.bucketed(fresh, name, ["event_id"], 8, "append")
    # What is applied is in the ledger now: a redelivery finds nothing.
    again = changes.unapplied(batch, spark.table(name)).select("event_id")
    return fresh.unionByName(again)


case("upsert_bucketed", f"SELECT * FROM {BASE} WHERE user_id NOT IN (SELECT user_id FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM {LOG}) WHERE rn = 1) UNION ALL SELECT user_id, value, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM {LOG}) WHERE rn = 1")(lambda t: apply.upsert(apply.bucketed(base(t), f"target_{uuid.uuid4().hex}", ["user_id"], 8), changes.compact(log(t), ["user_id"], ["event_id"]).select("user_id", "value", "event_type"), ["user_id"]))


@case("usage_partitions", "SELECT n_name, CAST(o_orderdate AS DATE) AS day, count(*) AS orders, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_custkey END) AS finished_customers, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE year(o_orderdate) <> 1995 OR month(o_orderdate) > 1 OR o_orderkey % 2 = 0 GROUP BY 1, 2 ORDER BY 1, 2")
def usage_partitions(t: Tables) -> DataFrame:
    """A rollup stored by month: a batch rewrites the one month that it touches."""
    spark = t("orders").sparkSession
    path = storage.scratch(spark, "usage")
    month = F.date_format("day", "yyyy-MM").alias("month")
    january = "year(o_orderdate) = 1995 AND month(o_orderdate) = 1"
    apply.overwrite_partitions(usage(t, None, usage_rows(t)).select("*", month), path, ["month"])
    before = set(storage.files(spark, path))
    batch = usage(t, None, usage_rows(t).where(f"{january} AND o_orderkey % 2 = 0"))
    apply.overwrite_partitions(batch.select("*", month), path, ["month"])
    after = set(storage.files(spark, path))
    touched = {f for f in before ^ after if "month=1995-01" not in f}
    found = spark.read.parquet(path).drop("month")
    return found if not touched else found.where("false")


@case("audit_partitions", "SELECT event_id, ts, CAST(ts AS DATE) AS day FROM events")
def audit_partitions(t: Tables) -> DataFrame:
    """An audit log stored by day, in two appends."""
    spark = t("events").sparkSession
    path = storage.scratch(spark, "audit")
    for i in range(2):
        apply.record(stamped(t("events")).where(f"event_id % 2 = {i}").select("event_id", "ts").repartition(1), path, "ts")
    return spark.read.parquet(path).select("event_id", "ts", F.col("day").cast("date").alias("day"))


@case("footer_counts", "SELECT 'orders' AS name, count(*) AS rows, min(o_orderkey) AS least, max(o_orderkey) AS most FROM orders UNION ALL SELECT 'lineitem', count(*), min(l_orderkey), max(l_orderkey) FROM lineitem UNION ALL SELECT 'events', count(*), min(event_id), max(event_id) FROM events")
def footer_counts(t: Tables) -> DataFrame:
    """Rows and bounds of tables out of their footers."""
    spark, rows = t("orders").sparkSession, []
    for name, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey"), ("events", "event_id")):
        found = logs.footer_counts(spark, t(name).inputFiles()[0].rpartition(f"{name}.parquet")[0] + f"{name}.parquet", [key])
        rows.append((name, found["rows"], found[f"min_{key}"], found[f"max_{key}"]))
    return spark.createDataFrame(rows, "name string, rows bigint, least bigint, most bigint")


@case("profile_merged", """SELECT c AS "column", n AS total, n - k AS nulls, lo AS least, hi AS most, round(mean, 6) AS mean, round(dev, 6) AS deviation, true AS distinct_near, CASE WHEN mean IS NOT NULL THEN true END AS median_near FROM (
SELECT 'value' AS c, count(*) AS n, count(value) AS k, CAST(min(value) AS VARCHAR) AS lo, CAST(max(value) AS VARCHAR) AS hi, avg(value) AS mean, stddev_samp(value) AS dev FROM events UNION ALL
SELECT 'user_id', count(*), count(user_id), CAST(min(user_id) AS VARCHAR), CAST(max(user_id) AS VARCHAR), avg(user_id), stddev_samp(user_id) FROM events UNION ALL
SELECT 'event_type', count(*), count(event_type), min(event_type), max(event_type), NULL, NULL FROM events)""")
def profile_merged(t: Tables) -> DataFrame:
    """Profiles of five batches, stored, merged by pairs and described; estimates are held against exact values of all rows."""
    spark, columns = t("events").sparkSession, ["value", "user_id", "event_type"]
    parts = [storage.written(quality.sketched(t("events").where(F.pmod(F.xxhash64("event_id"), F.lit(5)) == i), columns), "profile") for i in range(5)]
    two = storage.written(quality.merged(parts[0].unionByName(parts[1])), "profile")
    rest = parts[2].unionByName(parts[3]).unionByName(parts[4])
    found = quality.described(quality.merged(two.unionByName(rest)))
    exact = None
    for c in columns:
        counts = t("events").groupBy(F.col(c).alias("v")).agg(F.count("*").alias("n")).where("v IS NOT NULL")
        medians = found.where(F.col("column") == c).select(F.col("median").alias("m"))
        below = counts.join(F.broadcast(medians), how="cross") if c != "event_type" else counts.withColumn("m", F.lit(None).cast("double"))
        number = F.col("v").try_cast("double") if c == "event_type" else F.col("v").cast("double")
        share = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0)) / F.sum("n")
        one = below.agg(F.count("*").alias("d"), share(number < F.col("m")).alias("below"), share(number <= F.col("m")).alias("upto")).select(F.lit(c).alias("c"), "*")
        exact = one if exact is None else exact.unionByName(one)
    met = found.join(exact, found["column"] == exact["c"])
    return met.select("column", "total", "nulls", "least", "most", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"), (F.abs(F.col("distinct") - F.col("d")) <= F.greatest(F.lit(1), 0.05 * F.col("d"))).alias("distinct_near"), F.when(F.col("median").isNotNull(), (F.col("below") <= 0.52) & (F.col("upto") >= 0.48)).alias("median_near"))


# -- rules over time -----------------------------------------------------------------------------
_SERIES = "(SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, avg(value) AS value FROM events GROUP BY 1, 2)"


def hourly(t: Tables) -> DataFrame:
    return metrics.buckets(stamped(t("events")), ["event_type"], size="1 hour")


case("change_alerts", f"SELECT a.event_type, a.start, round(a.value, 6) AS value, round((a.value - b.value) * 100 / abs(b.value), 6) AS change FROM {_SERIES} a JOIN {_SERIES} b ON a.event_type = b.event_type AND a.start = b.start + INTERVAL 1 HOUR WHERE b.value <> 0 AND abs((a.value - b.value) * 100 / abs(b.value)) > 50")(lambda t: metrics.changed(hourly(t), ["event_type"], 50, 3600).select("event_type", "start", F.round("value", 6).alias("value"), F.round("change", 6).alias("change")))
case("outlier_alerts", f"""WITH s AS (SELECT * FROM {_SERIES} WHERE value IS NOT NULL),
h AS (SELECT *, list_sort(list(value) OVER (PARTITION BY event_type ORDER BY start RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND INTERVAL 1 SECOND PRECEDING)) AS held FROM s),
m AS (SELECT *, held[(len(held) + 1) // 2] AS median FROM h WHERE len(held) >= 5),
d AS (SELECT *, 1.4826::DOUBLE * list_sort(list_transform(held, lambda x: abs(x - median)))[(len(held) + 1) // 2] AS deviation FROM m)
SELECT event_type, start, round(value, 6) AS value, round(median, 3) AS median, round(deviation, 3) AS deviation FROM d WHERE abs(value - median) > 3 * deviation""")(lambda t: metrics.outliers(hourly(t), ["event_type"], 86_400, 3.0).select("event_type", "start", F.round("value", 6).alias("value"), F.round("median", 3).alias("median"), F.round("deviation", 3).alias("deviation")))
case("sequence_alerts", """SELECT user_id, first, last FROM (SELECT user_id, ts AS first, event_type AS a, lead(event_type, 1) OVER w AS b, lead(event_type, 2) OVER w AS c, lead(ts, 2) OVER w AS last FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
WHERE a = 'click' AND b IN ('view', 'error') AND c <> 'signup' AND last - first <= INTERVAL 12 HOUR""")(lambda t: metrics.sequences(stamped(t("events")), ["user_id"], ["event_type = 'click'", "event_type IN ('view', 'error')", "event_type <> 'signup'"], 12 * 3600, ties=["event_id"]))

RULES = [
    {"alert": "high", "condition_type": "threshold", "condition": {"metric": "value", "operator": "gt", "value": 60}, "window_minutes": 60, "consecutive_failures": 2, "severity": "critical"},
    {"alert": "jump", "condition_type": "change", "condition": {"metric": "value", "change_type": "increase", "threshold": 100}, "window_minutes": 60},
    {"alert": "fall", "condition_type": "pattern", "condition": {"metric": "value", "pattern": ["value > 60", "value < 40", "value < 40"]}, "window_minutes": 60, "severity": "error"},
]


@case("alert_rules", f"""WITH s AS {_SERIES},
f AS (SELECT event_type, start, value, 'high' AS alert, coalesce(value > 60, false) AS flag FROM s
UNION ALL SELECT a.event_type, a.start, a.value, 'jump', coalesce((a.value - b.value) * 100 / abs(b.value) > 100 AND b.value <> 0, false) FROM s a LEFT JOIN s b ON a.event_type = b.event_type AND a.start = b.start + INTERVAL 1 HOUR
UNION ALL SELECT event_type, start, value, 'fall', coalesce(lag(value, 2) OVER w > 60 AND lag(value) OVER w < 40 AND value < 40 AND start - lag(start, 2) OVER w <= INTERVAL 3 HOUR, false) FROM s WINDOW w AS (PARTITION BY event_type ORDER BY start)),
r AS (SELECT *, sum(CASE WHEN flag AND NOT coalesce(before AND start - earlier = INTERVAL 1 HOUR, false) THEN 1 ELSE 0 END) OVER (PARTITION BY event_type, alert ORDER BY start) AS run FROM (SELECT *, max(start) OVER (PARTITION BY event_type, alert) AS newest, lag(flag) OVER (PARTITION BY event_type, alert ORDER BY start) AS before, lag(start) OVER (PARTITION BY event_type, alert ORDER BY start) AS earlier FROM f)),
e AS (SELECT event_type, alert, min(start) AS first, max(start) AS last, count(*) AS windows, max(value) AS peak, any_value(newest) AS newest FROM r WHERE flag GROUP BY event_type, alert, run)
SELECT event_type, alert, CASE alert WHEN 'high' THEN 'critical' WHEN 'fall' THEN 'error' ELSE 'warning' END AS severity, CASE WHEN alert = 'high' THEN first + INTERVAL 1 HOUR ELSE first END AS triggered_at, CASE WHEN last < newest THEN last + INTERVAL 1 HOUR END AS resolved_at, windows, round(peak, 6) AS peak
FROM e WHERE windows >= CASE WHEN alert = 'high' THEN 2 ELSE 1 END""")
def alert_rules(t: Tables) -> DataFrame:
    """Episodes of three kinds of rules over hourly means."""
    samples = stamped(t("events")).select("event_type", "ts", F.lit("value").alias("metric"), "value")
    return metrics_alerts.alerts(samples, RULES, ["event_type"]).withColumn("peak", F.round("peak", 6))


case("detect_threshold", f"SELECT event_type, start, round(value, 6) AS value FROM {_SERIES} WHERE value < 5 OR value > 120")(lambda t: metrics.detect(hourly(t), ["event_type"], {"detection_type": "threshold", "config": {"min": 5, "max": 120}}).select("event_type", "start", F.round("value", 6).alias("value")))
case("rolling_counts", "SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 599999999 PRECEDING AND CURRENT ROW) AS recent FROM events")(lambda t: metrics.rolling(stamped(t("events")), ["event_type"], 600).select("event_id", "recent"))


@case("document_resume", "SELECT event_id, event_type AS collection, false AS lost FROM events WHERE event_id > 5000 AND event_type <> 'error' UNION ALL SELECT event_id, event_type, false FROM events WHERE event_type = 'view' AND event_id <= 5000 UNION ALL SELECT NULL, 'error', true")
def document_resume(t: Tables) -> DataFrame:
    """Change streams go on after their tokens; one collection is new, and one's token is no longer in its log."""
    records = t("events").select("event_id", F.col("event_type").alias("collection"), F.col("event_id").alias("position"), F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("_id"))
    tokens = logs.resume_tokens(records.where("position <= 5000 AND collection <> 'view'")).withColumn("_id", F.when(F.col("collection") == "error", "gone").otherwise(F.col("_id")))
    rest, lost = logs.resumed(records, tokens)
    return rest.select("event_id", "collection", F.lit(False).alias("lost")).unionByName(lost.select(F.lit(None).cast("bigint").alias("event_id"), "collection", F.lit(True).alias("lost")))


# -- table functions -----------------------------------------------------------------------------
case("table_runs", """SELECT user_id, event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS island FROM events) GROUP BY user_id, event_type, island""")(lambda t: pipeline.run(t("events").select("event_id", "user_id", "event_type"), {"transforms": [{"type": "table_function", "name": "runs", "args": ["user_id", "event_id", "event_type"]}]}).rows)
case("table_pieces", "SELECT c_custkey, c_name, CAST(i AS BIGINT) AS number, string_split(c_name, '#')[i] AS piece FROM customer, unnest(range(1, len(string_split(c_name, '#')) + 1)) r(i)")(lambda t: pipeline.run(t("customer").select("c_custkey", "c_name"), {"transforms": [{"type": "table_function", "name": "pieces", "args": ["c_name", "#"]}]}).rows)

# -- what was weak -------------------------------------------------------------------------------
_TEXT_KEY = "substring(md5(CAST(o_orderkey % 5000 AS VARCHAR)), 1, 12)"
case("keyset_text", f"SELECT page, min(k) AS first, max(k) AS last, count(*) AS n FROM (SELECT k, (row_number() OVER (ORDER BY k) - 1) // 250 AS page FROM (SELECT {_TEXT_KEY} AS k FROM orders)) GROUP BY page")(lambda t: logs.pages(t("orders").select(F.substring(F.md5((F.col("o_orderkey") % 5000).cast("string")), 1, 12).alias("k")), "k", 250).groupBy("page").agg(F.min("k").alias("first"), F.max("k").alias("last"), F.count("*").alias("n")))
case("write_upsert", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1 UNION ALL SELECT -1 - o_orderkey, 0 FROM orders")(lambda t: apply.write("upsert", t("orders").select((-1 - F.col("o_orderkey")).alias("user_id"), F.lit(0).cast("long").alias("event_id")).unionByName(t("events").select("user_id").distinct().withColumn("event_id", F.lit(-1).cast("long"))), t("events").select("user_id", "event_id"), ["user_id"], ["event_id"]))
case("write_replace", "SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0")(lambda t: apply.write("replace", t("customer").select("c_custkey"), t("customer").where("c_custkey % 3 = 0").select("c_custkey")))
_DAYS = f"(SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY event_id DESC) AS rn FROM (SELECT *, date_trunc('day', ts) AS day FROM {LOG}))"
case("sync_history_ties", f"SELECT user_id, value, valid_from, valid_to, is_deleted FROM (SELECT user_id, value, op, CAST(day AS TIMESTAMP) AS valid_from, lead(CAST(day AS TIMESTAMP)) OVER w AS valid_to, coalesce(lead(op) OVER w = 'd', false) AS is_deleted FROM {_DAYS} WHERE rn = 1 WINDOW w AS (PARTITION BY user_id ORDER BY day)) WHERE op <> 'd'")(lambda t: apply.sync("cdc", None, log(t).select("user_id", "value", "op", F.date_trunc("day", F.col("ts").cast("timestamp")).alias("valid_from"), "event_id"), ["user_id"], order=["event_id"]).select("user_id", "value", "valid_from", "valid_to", "is_deleted"))


@case("pipeline_quarantine", "SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, event_id % 10 = 0 AS bad FROM events WHERE props IS NOT NULL")
def pipeline_quarantine(t: Tables) -> DataFrame:
    """Rows whose JSON has something behind it stay out of the steps and come back beside the result."""
    events = t("events").where("props IS NOT NULL").select("event_id", F.when(F.col("event_id") % 10 == 0, F.concat("props", F.lit(" trash"))).otherwise(F.col("props")).alias("props"))
    out = pipeline.run(events, {"transforms": [{"type": "json_extract", "column": "props", "path": "$.k", "output_type": "long", "output_column": "k"}]}, quarantine=True)
    good, bad = out.rows.select("event_id", "k", F.lit(False).alias("bad")), out.quarantine.select("event_id", F.lit(None).cast("bigint").alias("k"), F.lit(True).alias("bad"))
    return good.unionByName(bad)


def _database(t: Tables) -> str:
    """Customers in an embedded database, as a source over JDBC."""
    url = f"jdbc:derby:memory:tidemark_{uuid.uuid4().hex};create=true"
    rows = t("customer").select(F.col("c_custkey").alias("C_CUSTKEY"), F.col("c_name").alias("C_NAME"), F.col("c_acctbal").alias("C_ACCTBAL"))
    options = {"createTableColumnTypes": "C_NAME VARCHAR(64)"}
    rows.coalesce(1).write.options(**options).jdbc(url, "CUSTOMERS", mode="overwrite")
    return url


@case("jdbc_scan", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def jdbc_scan(t: Tables) -> DataFrame:
    """A table over JDBC, a partition a key range."""
    low, high = t("customer").agg(F.min("c_custkey"), F.max("c_custkey")).first()
    read = logs.jdbc(t("customer").sparkSession, _database(t), "CUSTOMERS", ranges.predicates("C_CUSTKEY", ranges.split(low, high, 4)))
    return read.toDF("c_custkey", "c_name", "c_acctbal")


case("jdbc_incremental", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal >= 5000")(lambda t: logs.jdbc(t("customer").sparkSession, _database(t), "CUSTOMERS", cursor="C_ACCTBAL", mark="5000").select(F.col("C_CUSTKEY").alias("c_custkey"), F.col("C_ACCTBAL").alias("c_acctbal")))
case("key_candidates", """SELECT c AS "column", n AS total, n - k AS nulls, d AS "distinct", n > 0 AND n = k AND d = n AS is_key FROM (SELECT 'o_orderkey' AS c, count(*) AS n, count(o_orderkey) AS k, count(DISTINCT o_orderkey) AS d FROM orders UNION ALL SELECT 'o_custkey', count(*), count(o_custkey), count(DISTINCT o_custkey) FROM orders UNION ALL SELECT 'o_totalprice', count(*), count(o_totalprice), count(DISTINCT o_totalprice) FROM orders)""")(lambda t: logs.key_candidates(t("orders"), ["o_orderkey", "o_custkey", "o_totalprice"]))


@case("coerce_policy", "SELECT user_id, CASE WHEN event_id % 100 = 0 THEN 'n/a' ELSE CAST(event_id AS VARCHAR) END AS amount, event_id AS n FROM events UNION ALL SELECT -1 - o_orderkey, CAST(o_custkey AS VARCHAR), o_orderkey FROM orders")
def coerce_policy(t: Tables) -> DataFrame:
    """A column whose type a batch no longer fits becomes text, in the table and the batch; the others keep theirs."""
    table = t("orders").select((-1 - F.col("o_orderkey")).alias("user_id"), F.col("o_custkey").alias("amount"), F.col("o_orderkey").alias("n"))
    batch = t("events").select("user_id", F.when(F.col("event_id") % 100 == 0, "n/a").otherwise(F.col("event_id").cast("string")).alias("amount"), F.col("event_id").cast("string").alias("n"))
    held, new = apply.coerced(table, batch, ["user_id"])
    return held.unionByName(new)


@case("jdbc_pushdown", "SELECT count(*) AS n, max(c_acctbal) AS most FROM customer WHERE c_custkey % 2 = 0")
def jdbc_pushdown(t: Tables) -> DataFrame:
    """A query that the source runs itself: one row travels."""
    found = logs.jdbc_query(t("customer").sparkSession, _database(t), "SELECT COUNT(*) AS N, MAX(C_ACCTBAL) AS MOST FROM CUSTOMERS WHERE MOD(C_CUSTKEY, 2) = 0")
    return found.select(F.col("N").cast("bigint").alias("n"), F.col("MOST").alias("most"))


@case("discover_catalog", "SELECT * FROM (VALUES ('CUSTOMERS', 'C_CUSTKEY', 'bigint', false, 1, false), ('CUSTOMERS', 'C_NAME', 'varchar', true, NULL, true), ('CUSTOMERS', 'C_ACCTBAL', 'double', true, NULL, false)) v(table_name, column_name, data_type, is_nullable, key_position, json_candidate) WHERE EXISTS (SELECT 1 FROM customer)")
def discover_catalog(t: Tables) -> DataFrame:
    """All tables of a source with their keys, as its driver describes them."""
    spark, url = t("customer").sparkSession, _database(t)
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    for statement in ("ALTER TABLE CUSTOMERS ALTER COLUMN C_CUSTKEY NOT NULL", "ALTER TABLE CUSTOMERS ADD PRIMARY KEY (C_CUSTKEY)"):
        connection.createStatement().execute(statement)
    connection.close()
    return logs.catalog_of(spark, url, "APP").drop("schema_name")


@case("versioned_overwrite", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 3 = 2")
def versioned_overwrite(t: Tables) -> DataFrame:
    """Three full refreshes: a reader sees the last one, and the version before is still there for who began with it."""
    spark = t("orders").sparkSession
    path, orders = storage.scratch(spark, "versions"), t("orders").select("o_orderkey", "o_totalprice")
    for i in range(3):
        apply.publish_version(orders.where(f"o_orderkey % 3 = {i}"), path)
        held = apply.current(spark, path)
    return held


@case("evolve_table", "SELECT CAST(c_custkey AS DOUBLE) AS k, c_name AS name, NULL AS nation FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey + 0.5::DOUBLE, NULL, CAST(c_nationkey AS VARCHAR) FROM customer WHERE c_custkey % 2 = 1")
def evolve_table(t: Tables) -> DataFrame:
    """A stored table that a batch with a wider key and a new column widens; the batch lacks one of its columns."""
    spark = t("customer").sparkSession
    path = storage.scratch(spark, "evolved")
    apply.publish_version(t("customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").cast("int").alias("k"), F.col("c_name").alias("name")), path)
    batch = t("customer").where("c_custkey % 2 = 1").select((F.col("c_custkey") + F.lit(0.5)).alias("k"), F.col("c_nationkey").cast("string").alias("nation"))
    held, new, _ = apply.evolved(apply.current(spark, path), batch)
    apply.publish_version(held.unionByName(new), path)
    return apply.current(spark, path)


@case("patched_pipeline", "SELECT o_orderkey, CAST(o_totalprice AS VARCHAR) AS o_totalprice FROM orders")
def patched_pipeline(t: Tables) -> DataFrame:
    """A pipeline follows a table whose schema has changed: the cast of a changed column follows its type, steps of a removed one go."""
    spec = {"transforms": [{"type": "cast", "column": "o_totalprice", "to_type": "int"}, {"type": "string_op", "column": "o_comment", "op": "upper"}]}
    before = t("orders").select("o_orderkey", F.col("o_totalprice").cast("int").alias("o_totalprice"), F.lit("x").alias("o_comment"))
    now = t("orders").select("o_orderkey", F.col("o_totalprice").cast("string").alias("o_totalprice"))
    for change in schemas.diff(columns_of(before, "orders"), columns_of(now, "orders")).collect():  # a row a changed column
        spec = schemas.patch_spec(spec, change.column_name, change.change, change.new_type)
    return pipeline.run(now, spec).rows


@case("pipeline_preview", "SELECT count(*) AS n, true AS masked FROM (SELECT * FROM customer LIMIT 20)")
def pipeline_preview(t: Tables) -> DataFrame:
    """The first rows through the real pipeline."""
    spec = {"transforms": [{"type": "mask", "column": "c_name", "strategy": "full", "output_column": "m"}]}
    return pipeline.preview(t("customer").select("c_name"), spec, 20).agg(F.count("*").alias("n"), F.bool_and(F.col("m") != F.col("c_name")).alias("masked"))


#: A time in the middle of the test data's month.
_MIDDLE = datetime(2024, 1, 16)
case("last_30d_inside", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-16' - INTERVAL 30 DAY AND ts <= TIMESTAMP '2024-01-16'")(lambda t: metrics.within(t("events"), "ts", "30d", _MIDDLE).select("event_id"))
