import json
import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark import storage
from tidemark.functions import tables
from tidemark.operators import apply, changes, metrics, quality, ranges, sweep
from tidemark.plans import pipeline
from tidemark.sources import logs, streams
from tidemark.streaming import delivery, eventtime, ordered, runner


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def plan(df):
    return df._jdf.queryExecution().toString()


# -- logs by key


def published(spark, root, events, segment=3):
    df = spark.createDataFrame([(k, json.dumps({"id": i}), i) for k, i in events], "k string, line string, i int")
    streams.publish(df, root, "k", "line", "i", segment)


def test_log_files_say_what_they_hold(spark, tmp_path):
    root = f"{tmp_path}/log"
    published(spark, root, [("a", i) for i in range(8)] + [("b", 0)])
    published(spark, root, [("a", i) for i in range(8, 10)])
    assert streams.ends(root, ["a", "b", "c"]) == {"a": 10, "b": 1, "c": 0}
    reader = streams.LogReader(root, ["a", "b"], "g", "earliest")
    assert reader.initialOffset() == {"a": 0, "b": 0} and reader.latestOffset() == {"a": 10, "b": 1}
    found = [x for p in reader.partitions({"a": 2, "b": 0}, {"a": 9, "b": 1}) for x in reader.read(p)]
    assert [(k, n, json.loads(line)["id"]) for k, n, line in found] == [("a", i, i) for i in range(2, 9)] + [("b", 0, 0)]


def test_batches_by_count_or_time(spark, tmp_path):
    root, now = f"{tmp_path}/log", [0.0]
    published(spark, root, [("a", i) for i in range(5)])
    reader = streams.LogReader(root, ["a"], "g", "earliest", max_events=4, max_wait=60, clock=lambda: now[0])
    reader.initialOffset()
    assert reader.latestOffset() == {"a": 4}  # as many as a batch takes
    assert reader.latestOffset() == {"a": 4}  # one is left and waits
    now[0] = 59
    assert reader.latestOffset() == {"a": 4}
    now[0] = 61
    assert reader.latestOffset() == {"a": 5}
    assert reader.latestOffset() == {"a": 5}


def test_groups_keep_their_place(spark, tmp_path):
    root = f"{tmp_path}/log"
    published(spark, root, [("a", i) for i in range(4)])

    def read(checkpoint, group="g", start="latest", keys=("a",)):
        lines = streams.log_stream(spark, root, list(keys), group, start)
        runner.to_table(lines, f"{tmp_path}/{checkpoint}-out", f"{tmp_path}/{checkpoint}")
        return [r.position for r in spark.read.schema(streams._SCHEMA).parquet(f"{tmp_path}/{checkpoint}-out").orderBy("position").collect()]

    assert read("c1") == []  # the group begins at the end
    published(spark, root, [("a", i) for i in range(4, 6)])
    assert read("c1") == [4, 5]
    published(spark, root, [("a", 6)])
    assert read("c1") == [4, 5, 6]
    # The last batch is not acknowledged yet: a query with a new checkpoint is given it again, and nothing before it.
    assert streams.Group(root, "g").pending(["a"]) == 1 and read("c2") == [6]
    assert read("c3", "other", "earliest") == list(range(7))
    # A key that is new to the group begins when it is first asked for.
    published(spark, root, [("b", 0)])
    assert read("c1", keys=("a", "b")) == [4, 5, 6]
    published(spark, root, [("b", 1)])
    assert read("c1", keys=("a", "b")) == [1, 4, 5, 6]
    with pytest.raises(Exception, match="start must be"):
        read("c4", start="nowhere")


def test_acknowledged_files_can_go(spark, tmp_path):
    root = f"{tmp_path}/log"
    published(spark, root, [("a", i) for i in range(10)])
    assert streams.trim(root, ["a"]) == 0  # nobody has read it
    one, two = streams.Group(root, "one"), streams.Group(root, "two")
    one.update("begin", {"a": 0})
    one.update("acked", {"a": 10})
    two.update("begin", {"a": 7})
    assert streams.groups(root) == ["one", "two"] and streams.trim(root, ["a", "b"]) == 2
    assert streams.ends(root, ["a"]) == {"a": 10}
    reader = streams.LogReader(root, ["a"], "two", "latest")
    assert reader.initialOffset() == {"a": 7} and [n for p in reader.partitions({"a": 7}, {"a": 10}) for _, n, _ in reader.read(p)] == [7, 8, 9]


def test_entries_that_are_no_events_are_skipped(spark):
    lines = spark.createDataFrame([("k", i, x) for i, x in enumerate(['{"a": 1}', "broken", "[1]", "{}", "", None, '{"a": 2} x', '{"b": 3}'])], "key string, position bigint, line string")
    good, bad = streams.decoded(lines, "a int")
    assert rows(good) == [("k", 0, 1), ("k", 7, None)] and sorted(r.position for r in bad.collect()) == [1, 2, 3, 4, 5, 6]


def test_latest_survives_a_restart(spark, tmp_path):
    folder, check = tmp_path / "log", f"{tmp_path}/check"
    folder.mkdir()
    (folder / "old.jsonl").write_text('{"op": "c", "ts_ms": 1}\n')
    time.sleep(1.1)  # files have whole seconds on some systems

    def read():
        runner.to_table(runner.log_events(spark, str(folder), "latest", checkpoint=check), f"{tmp_path}/out", check)
        return [r.ts_ms for r in spark.read.schema(f"{runner.EVENT}, line string").parquet(f"{tmp_path}/out").collect()]

    assert read() == []
    time.sleep(1.1)
    (folder / "new.jsonl").write_text('{"op": "c", "ts_ms": 2}\n')  # while the query is down
    time.sleep(1.1)
    assert read() == [2]


# -- order


def test_each_connection_in_order(spark, tmp_path):
    r = random.Random(1)
    sent = [(c, i) for c in "ab" for i in range(1, 30) if (c, i) not in (("a", 7), ("a", 8), ("b", 1))]
    r.shuffle(sent)
    sent += sent[:6]
    batches = [sent[i : i + 20] for i in range(0, len(sent), 20)] + [[("z", 1)], [("z", 2)], [("a", 8), ("a", 8), ("a", 30)], [("z", 3)]]
    at = 1_700_000_000
    for i, b in enumerate(batches):
        at += 10 if i < len(batches) - 4 else 10_000
        spark.createDataFrame([(c, n, at) for c, n in b], "c string, n long, at long").select("c", "n", F.timestamp_seconds("at").alias("at")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = runner.file_events(spark, f"{tmp_path}/in", "c string, n long, at timestamp", 1)
    with storage.settings(spark, {"spark.sql.streaming.stateStore.providerClass": ordered.ROCKSDB}):
        runner.to_table(ordered.in_order(source, ["c"], "n", "at", gap="1 hour"), f"{tmp_path}/out", f"{tmp_path}/check")
    found = spark.read.parquet(f"{tmp_path}/out")
    by = {c: [(x.seq, x.late) for x in found.where(F.col("c") == c).orderBy("place").collect()] for c in "ab"}
    assert by["a"] == [(i, False) for i in range(1, 30) if i not in (7, 8)] + [(8, True), (30, False)]
    assert by["b"] == [(i, False) for i in range(2, 30)]
    assert [json.loads(x.payload)["n"] for x in found.where("c = 'b'").orderBy("place").collect()] == list(range(2, 30))


# -- deliveries


def test_attempts_survive_and_spend_their_budget(spark, tmp_path):
    spark.range(3).coalesce(1).write.parquet(f"{tmp_path}/in")
    source, seen, pauses = runner.file_events(spark, f"{tmp_path}/in", "id bigint"), [], []

    def sink(df, number):
        seen.append(number)
        raise OSError("away")

    def build():
        out = source.writeStream.foreachBatch(delivery.durable(sink, delivery.Attempts(spark, f"{tmp_path}/attempts"), f"{tmp_path}/dead", 4))
        return out.option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()

    with pytest.raises(Exception, match="away"):
        build().awaitTermination()
    assert delivery.Attempts(spark, f"{tmp_path}/attempts").pending() == {0: 1}
    assert delivery.supervised(build, base=1, most=3, sleep=pauses.append, chance=lambda: 0.5) == 3
    assert len(seen) == 4 and pauses == [2.0, 3.0, 3.0]
    dead = spark.read.parquet(f"{tmp_path}/dead").collect()
    assert len(dead) == 3 and all("away" in r.reason and r.deliveries == 4 for r in dead)
    assert delivery.Attempts(spark, f"{tmp_path}/attempts").pending() == {}
    with pytest.raises(Exception, match="always"):
        delivery.supervised(lambda: Broken(), restarts=2, sleep=pauses.append)


class Broken:
    lastProgress = None

    def awaitTermination(self):
        raise OSError("always")


def test_pauses_are_spread():
    found = [delivery.pause(2, 1.0, 60.0) for _ in range(200)]
    assert 2.0 <= min(found) < max(found) <= 6.0 and delivery.pause(20, 1.0, 60.0, lambda: 0.5) == 60.0


# -- event time


def test_late_rows_and_a_repeated_batch(spark, tmp_path):
    got = {}
    keep = lambda name: lambda df, n: got.__setitem__((name, n), sorted(r.i for r in df.collect()))
    run = eventtime.split_late(keep("on"), keep("late"), "ts", eventtime.Mark(spark, f"{tmp_path}/mark"), "10 seconds")
    batch = lambda *x: spark.createDataFrame([(i, t) for i, t in x], "i int, s long").select("i", F.timestamp_seconds("s").alias("ts"))
    run(batch((1, 100), (2, None)), 0)
    run(batch((3, 89), (4, 90), (5, 200)), 1)
    again = dict(got)
    run(batch((3, 89), (4, 90), (5, 200)), 1)  # as after a crash
    assert got == again
    run(batch((6, 189), (7, 150), (8, 190), (9, None)), 2)
    assert got == {("on", 0): [1, 2], ("late", 0): [], ("on", 1): [4, 5], ("late", 1): [3], ("on", 2): [8, 9], ("late", 2): [6, 7]}


# -- sweeps


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_sweeps_like_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(sweep, "PART_ROWS", 20)
    r = random.Random(seed)
    bound = lambda x: None if r.random() < 0.15 else x
    spans = [(i, bound(lo := r.randrange(100)), bound(lo + r.choice([1, 5, 30]))) for i in range(40)]
    files = [(100 + i, bound(lo := r.randrange(100)), bound(lo + r.choice([1, 5, 30]))) for i in range(60)]
    low, high = (lambda x: -1e9 if x is None else x), (lambda x: 1e9 if x is None else x)
    df = lambda x: spark.createDataFrame(x, "path int, lo int, hi int")
    points = spark.createDataFrame([(i,) for i in range(-3, 140)], "k int")
    got = {x.k: x.covered for x in ranges.covered(points, F.col("k"), df(spans)).collect()}
    assert got == {k: any(low(a) < k <= high(b) for _, a, b in spans) for k in range(-3, 140)}
    found = {x.path: (x.meets, x.inside) for x in ranges.meeting(df(files), df(spans)).collect()}
    assert found == {p: (any(low(c) < high(b) and low(a) < high(d) for _, c, d in spans), any(low(c) <= low(a) and high(d) >= high(b) for _, c, d in spans)) for p, a, b in files}
    known = [f for f in files if f[1:] != (None, None)]
    inside = lambda x, y: low(y[1]) <= low(x[1]) and high(y[2]) >= high(x[2])
    stay = [x for x in known if not any(y[0] != x[0] and inside(x, y) and (not inside(y, x) or y[0] < x[0]) for y in known)]
    committed = [s for s in spans if s[1:] != (None, None)]
    want = {}
    for x in files:
        if x[1:] == (None, None):
            want[x[0]] = "add"
        elif x not in stay or any(inside(x, c) for c in committed):
            want[x[0]] = "skip"
        else:
            partly = any(low(y[1]) < low(x[1]) < high(y[2]) for y in stay)
            want[x[0]] = "dedup" if partly or any(low(c[1]) < high(x[2]) and low(x[1]) < high(c[2]) for c in committed) else "add"
    assert {x.path: x.action for x in ranges.admit(df(spans), df(files)).collect()} == want
    assert ranges.admit(df([]), df([])).count() == 0


def test_positions_of_text_keys(spark, monkeypatch):
    monkeypatch.setattr(sweep, "PART_ROWS", 10)
    keys = [f"k{i % 7:03}" for i in range(60)] + [None] * 5
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, i int")
    got = [(x.k, x.position) for x in sweep.positions(df, [], "k").orderBy("position").collect()]
    assert [p for _, p in got] == list(range(1, 66)) and [k for k, _ in got] == sorted(keys, key=lambda k: (k is not None, k or ""))


# -- stored tables


def test_bins_take_small_files_of_one_folder():
    sizes = {"a/1": 10, "a/2": 60, "a/3": 30, "a/4": 99, "b/1": 10, "c/1": 50, "c/2": 50, "c/3": 50}
    assert sorted(map(sorted, apply.bins(sizes, 100))) == [["a/1", "a/2", "a/3"], ["c/2", "c/3"]]


def test_compaction_keeps_partitions_and_survives_a_crash(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    rows_ = spark.range(1000).selectExpr("id", "id % 2 AS p", "'x' AS q")
    rows_.repartition(6).write.partitionBy("p", "q").parquet(path)
    want = rows(spark.read.parquet(path))
    done = apply.finish_compaction
    monkeypatch.setattr(apply, "finish_compaction", lambda *_: False)  # a crash after the journal
    apply.compact(spark, path)
    monkeypatch.setattr(apply, "finish_compaction", done)
    assert apply.finish_compaction(spark, path) and not apply.finish_compaction(spark, path)
    held = storage.files(spark, path)
    assert sorted(f.rpartition("/")[0].rpartition("/t/")[2] for f in held) == ["p=0/q=x", "p=1/q=x"]
    assert rows(spark.read.parquet(path)) == want
    assert apply.compact(spark, path)["rewritten"] == 0


def test_only_the_batch_is_exchanged(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ledger = apply.bucketed(spark.range(100).selectExpr("id AS event_id"), "ledger_test", ["event_id"], 4)
        fresh = changes.unapplied(spark.range(50, 150).selectExpr("id AS event_id"), ledger)
        fresh.collect()
        found = plan(fresh).split("== Final Plan ==")[-1].split("== Initial Plan ==")[0]
        table = next(i for i, line in enumerate(found.splitlines()) if "ledger_test" in line)
        above, depth = [], None
        for line in reversed(found.splitlines()[: table + 1]):
            own = len(line) - len(line.lstrip(" :+-"))
            if depth is None or own < depth:
                above.append(line)
                depth = own
        assert fresh.count() == 50 and not any("Exchange" in x for x in above)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE ledger_test")


def test_partitions_are_replaced_and_pruned(spark, tmp_path):
    path = f"{tmp_path}/t"
    apply.overwrite_partitions(spark.range(30).selectExpr("id", "id % 3 AS p"), path, ["p"])
    before = set(storage.files(spark, path))
    apply.overwrite_partitions(spark.createDataFrame([(99, 1)], "id long, p long"), path, ["p"])
    after = set(storage.files(spark, path))
    assert all("p=1" in f for f in before ^ after) and spark.read.parquet(path).count() == 21
    assert "PartitionFilters: [p" in plan(apply.touched(spark, path, "p", [1])).replace("isnotnull(p#", "[p").replace("[[", "[")


def test_counts_come_from_footers(spark, tmp_path):
    spark.range(1000).repartition(3).write.parquet(f"{tmp_path}/t")
    with storage.settings(spark, logs.FOOTERS):
        assert "PushedAggregation: [COUNT(*), MIN(id), MAX(id)]" in plan(logs.footer_plan(spark, f"{tmp_path}/t", ["id"]))
    assert logs.footer_counts(spark, f"{tmp_path}/t", ["id"]) == {"rows": 1000, "min_id": 0, "max_id": 999}


def test_profiles_merge(spark):
    df = spark.range(20_000).selectExpr("id", "id % 300 AS m", "CAST(id % 7 AS STRING) AS s", "CAST(NULL AS INT) AS e")
    parts = [quality.sketched(df.where(f"id % 4 = {i}"), df.columns) for i in range(4)]
    assert "Expand" not in plan(parts[0])
    whole = parts[0]
    for p in parts[1:]:
        whole = quality.merged(whole.unionByName(p))
    got = {r.column: r for r in quality.described(whole).collect()}
    assert got["id"].total == 20_000 and (got["id"].least, got["id"].most) == ("0", "19999") and got["e"].nulls == 20_000 and got["e"].median is None
    assert abs(got["id"].distinct - 20_000) < 1000 and abs(got["m"].distinct - 300) <= 10 and got["s"].distinct == 7
    assert abs(got["id"].median - 10_000) < 400 and abs(got["id"].mean - 9999.5) < 1e-6 and abs(got["id"].deviation - 5773.647) < 0.01
    empty = quality.described(quality.merged(quality.sketched(df.where("false"), df.columns))).collect()
    assert all(r.total == 0 and r.median is None for r in empty)


# -- applying


def test_upserts_take_the_last_row(spark):
    table = spark.createDataFrame([(1, 5)], "k int, v int")
    batch = spark.createDataFrame([(1, 9), (1, 10), (2, 10), (2, 9)], "k int, v int").coalesce(1)
    assert rows(apply.write("upsert", table, batch, ["k"], ["v"])) == [(1, 10), (2, 10)]
    assert rows(apply.write("upsert", table, batch, ["k"])) == [(1, 10), (2, 9)]  # as they come


def test_events_of_one_instant_leave_one_row_of_history(spark):
    events = spark.createDataFrame([("k", "x", "u", 1), ("k", "y", "u", 2), ("k", None, "d", 3), ("j", "a", "u", 1), ("j", "b", "u", 2)], "k string, v string, op string, n int")
    batch = events.withColumn("valid_from", F.timestamp_seconds(F.lit(5)))
    got = apply.sync("cdc", None, batch, ["k"], order=["n"])
    assert rows(got.select("k", "v", F.col("valid_to").isNull())) == [("j", "b", True)]


def test_columns_that_no_longer_fit_become_text(spark):
    table = spark.createDataFrame([(1, 5, 7.5)], "k int, v int, w double")
    held, new = apply.coerced(table, spark.createDataFrame([("2", "x", "1.5")], "k string, v string, w string"), ["k"])
    assert rows(held.unionByName(new)) == [(1, "5", 7.5), (2, "x", 1.5)]
    with pytest.raises(ValueError, match="keys"):
        apply.coerced(table, spark.createDataFrame([("x", 1, 1.0)], "k string, v int, w double"), ["k"])


def test_statements_that_only_speak_of_tables(spark):
    df = spark.createDataFrame([("query", "s", q) for q in ("INSERT INTO t VALUES ('DROP it')", "  alter table t add c int", "/* x */ DROP TABLE t", "CREATED")], "event_type string, schema_name string, query string")
    assert sorted(r.query for r in logs.table_changes(df).collect()) == ["  alter table t add c int", "/* x */ DROP TABLE t"]


def test_versions_replace_each_other(spark, tmp_path):
    path = f"{tmp_path}/t"
    with pytest.raises(FileNotFoundError):
        apply.current(spark, path)
    held = []
    for n in (1, 2, 3):
        apply.publish_version(spark.range(n), path)
        held.append(apply.current(spark, path))
    assert held[2].count() == 3 and held[1].count() == 2  # who began with the version before goes on with it
    assert len([f for f in (tmp_path / "t").iterdir() if f.name.startswith("v-")]) == 2
    apply.publish_version(apply.current(spark, path).where("id > 0"), path)
    assert apply.current(spark, path).count() == 2


# -- JSON


def test_json_with_something_behind_it(spark):
    texts = ['{"a":1}', '{"a":1} trash', '{"a":1},{"b":2}', "1", "1 2", "[1,2]", '"x"', "", None, "{", '{"a":1}]', "null"]
    good, bad = pipeline.split_json(spark.createDataFrame([(t,) for t in texts], "j string"), ["j"])
    assert sorted(map(str, (r.j for r in good.collect()))) == sorted(map(str, ['{"a":1}', "1", "[1,2]", '"x"', None, "null"]))
    assert bad.count() == 6


def test_streams_quarantine_json(spark, tmp_path):
    spark.createDataFrame([(1, '{"k":1}'), (2, '{"k":2} x'), (3, None)], "id int, j string").coalesce(1).write.parquet(f"{tmp_path}/in")
    spec = {"transforms": [{"type": "json_extract", "column": "j", "path": "$.k", "output_type": "long", "output_column": "k"}, {"type": "json_extract", "column": "k", "path": "$.z", "output_column": "z"}]}
    assert pipeline.json_columns(spec) == ["j"]
    sink = lambda df, n: df.select("id", "k").write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}")
    spec = {"transforms": spec["transforms"][:1]}
    runner.start(runner.file_events(spark, f"{tmp_path}/in", "id int, j string"), spec, None, sink, f"{tmp_path}/check", f"{tmp_path}/dead").awaitTermination()
    assert rows(spark.read.parquet(f"{tmp_path}/out").select("id", "k")) == [(1, 1), (3, None)]
    assert [json.loads(r.row)["id"] for r in spark.read.parquet(f"{tmp_path}/dead").collect()] == [2]


# -- rules over time


@pytest.mark.parametrize("within", [1, 7, 60])
def test_sequences_like_a_loop(spark, within):
    r = random.Random(within)
    data = sorted((r.choice("ab"), r.randrange(400), i, r.choice("xyz")) for i in range(300))
    df = spark.createDataFrame(data, "g string, s long, i int, e string").select("g", "i", "e", F.timestamp_seconds("s").alias("ts"))
    want = []
    for g in "ab":
        own = [x for x in data if x[0] == g]
        want += [(g, a[1], c[1]) for a, b, c in zip(own, own[1:], own[2:], strict=False) if (a[3], b[3]) == ("x", "y") and c[3] != "x" and c[1] - a[1] <= within]
    found = metrics.sequences(df, ["g"], ["e = 'x'", "e = 'y'", "e <> 'x'"], within, ties=["i"])
    assert rows(found.select("g", F.unix_seconds("first"), F.unix_seconds("last"))) == sorted(want, key=str)


def test_changes_and_outliers(spark):
    values = [10.0, 11.0, 10.0, 12.0, 11.0, 10.0, 90.0, 11.0, None, 30.0]
    series = spark.createDataFrame([("g", i * 60, v) for i, v in enumerate(values)], "g string, s long, value double").select("g", "value", F.timestamp_seconds("s").alias("start"))
    assert [(r.value, r.before) for r in metrics.changed(series, ["g"], 100, 60).orderBy("start").collect()] == [(90.0, 10.0)]
    assert [(r.value, r.median) for r in metrics.outliers(series, ["g"], 3600).orderBy("start").collect()] == [(90.0, 10.0), (30.0, 11.0)]


# -- table functions, discovery


def test_table_functions(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 2, "x"), ("b", 1, "y")], "g string, n int, v string")
    step = {"type": "table_function", "name": "runs", "args": ["g", "n", "v"]}
    assert rows(pipeline.run(df, {"transforms": [step]}).rows) == [("a", "x", 1, 2, 2), ("a", "y", 3, 3, 1), ("b", "y", 1, 1, 1)]
    tables.register(spark)
    assert spark.sql("SELECT piece FROM pieces(TABLE(SELECT 'p,q' AS t), 't', ',')").collect()[1].piece == "q"
    for bad in ({"name": "nope"}, {"name": "runs", "args": ["g", "n", "nope"]}):
        with pytest.raises(Exception, match="nope"):
            pipeline.run(df, {"transforms": [{"type": "table_function"} | bad]}).rows.collect()


def test_all_tables_of_a_source_and_their_keys(spark):
    url = "jdbc:derby:memory:discovery;create=true"
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    for statement in ("CREATE TABLE a (x INT NOT NULL, y VARCHAR(9) NOT NULL, z CLOB, PRIMARY KEY (y, x))", "CREATE TABLE b (n DOUBLE)"):
        connection.createStatement().execute(statement)
    connection.close()
    got = {(r.table_name, r.column_name): (r.is_nullable, r.key_position, r.json_candidate) for r in logs.catalog_of(spark, url, "APP").collect()}
    assert got == {("A", "X"): (False, 2, False), ("A", "Y"): (False, 1, True), ("A", "Z"): (True, None, True), ("B", "N"): (True, None, False)}


# -- alerts


def hours(spark, values, group="g"):
    data = [(group, i * 3600, v) for i, v in enumerate(values) if v != "missing"]
    return spark.createDataFrame(data, "g string, s long, value double").select("g", F.timestamp_seconds("s").alias("ts"), F.lit("m").alias("metric"), "value")


def test_episodes_begin_and_end(spark):
    from tidemark.operators import alerts

    samples = hours(spark, [1.0, 9.0, 9.0, 1.0, 9.0, "missing", 9.0, 9.0, 9.0])
    rule = {"alert": "a", "condition_type": "threshold", "condition": {"metric": "m", "operator": "gte", "value": 5}, "window_minutes": 60, "consecutive_failures": 2}
    found = alerts.alerts(samples, [rule], ["g"]).select(F.unix_seconds("triggered_at") / 3600, F.unix_seconds("resolved_at") / 3600, "windows", "peak")
    assert rows(found) == [(2.0, 3.0, 2, 9.0), (7.0, None, 3, 9.0)]
    quiet = alerts.alerts(samples, [rule | {"consecutive_failures": 1, "suppression_window_minutes": 240}], ["g"])
    assert [r[0] for r in quiet.select((F.unix_seconds("triggered_at") / 3600).alias("h")).orderBy("h").collect()] == [1.0, 6.0]
    assert alerts.alerts(samples.where("false"), [rule], ["g"]).count() == 0


def test_kinds_of_conditions(spark):
    from tidemark.operators import alerts

    samples = hours(spark, [10.0, 10.0, 11.0, 10.0, 9.0, 10.0, 40.0, 10.0, 4.0, 4.0])
    of = lambda kind, **c: [r[0] for r in alerts.alerts(samples, [{"alert": "a", "condition_type": kind, "condition": {"metric": "m"} | c, "window_minutes": 60}], ["g"]).select((F.unix_seconds("triggered_at") / 3600).alias("h")).orderBy("h").collect()]
    assert of("change", change_type="increase", threshold=100) == [6.0] and of("change", change_type="decrease", threshold=50) == [7.0]
    assert of("anomaly", sensitivity="high") == [6.0, 8.0] and of("pattern", pattern=["value > 30", "value < 20", "value < 5"]) == [8.0]
    for bad in ({"condition_type": "nope"}, {"condition_type": "change", "condition": {"metric": "m"}}, {"condition_type": "threshold", "condition": {"metric": "m", "operator": "nope", "value": 1}}):
        with pytest.raises(ValueError):
            alerts.checked({"alert": "a"} | bad)


def test_detection_types(spark):
    series = hours(spark, [10.0, 11.0, 10.0, 9.0, 10.0, 11.0, 50.0, 10.0, None, 2.0]).select("g", F.col("ts").alias("start"), "value")
    of = lambda **c: sorted(r.value for r in metrics.detect(series, ["g"], c).collect())
    assert of(detection_type="threshold", config={"min": 5, "max": 40}) == [2.0, 50.0]
    assert of(detection_type="statistical", sensitivity="low", baseline_period_days=1) == [2.0, 11.0, 50.0]  # most of what is before the first 11 is 10, without any deviation
    assert of(detection_type="pattern", config={"conditions": ["value > 40", "value < 20"]}) == [10.0]
    for bad in ({"detection_type": "ml"}, {"detection_type": "statistical", "sensitivity": "x"}, {"detection_type": "statistical", "baseline_period_days": 91}):
        with pytest.raises(ValueError):
            of(**bad)


@pytest.mark.parametrize("seconds", [1, 5, 100])
def test_counts_of_the_last_seconds(spark, seconds):
    r = random.Random(seconds)
    data = [(i, r.choice("ab"), r.randrange(3_000_000_00) // 1000) for i in range(200)]
    df = spark.createDataFrame(data, "i int, g string, ms long").select("i", "g", F.timestamp_millis("ms").alias("ts"))
    want = {i: sum(h == g and 0 <= t - u < seconds * 1000 for _, h, u in data) for i, g, t in data}
    assert {x.i: x.recent for x in metrics.rolling(df, ["g"], seconds).collect()} == want


def test_change_streams_go_on_after_their_tokens(spark):
    df = spark.createDataFrame([("a", i, f"a{i}") for i in range(4)] + [("b", 0, "b0"), ("c", 5, "c5")], "collection string, position int, _id string")
    tokens = spark.createDataFrame([("a", "a1"), ("c", "c2"), ("d", "d0")], "collection string, _id string")
    rest, lost = logs.resumed(df, tokens)
    assert rows(rest.select("_id")) == [("a2",), ("a3",), ("b0",)] and rows(lost) == [("c",), ("d",)]
    assert rows(logs.resume_tokens(df)) == [("a", "a3"), ("b", "b0"), ("c", "c5")]
