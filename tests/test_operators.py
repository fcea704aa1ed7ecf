import json
import random
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import apply, changes, metrics, quality, ranges, schemas, sweep
from tidemark.sources import clean, logs
from tidemark.streaming import runner


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_block_keeps_nulls_and_loses_nothing(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, 500.0)], "id int, v double")
    out = quality.apply(df, {"rules": [{"type": "range_check", "column": "v", "min": 0, "max": 100}], "on_fail": "block"})
    assert [r[0] for r in rows(out.passed)] == [1, 2] and [r[0] for r in rows(out.failed)] == [3]
    with pytest.raises(ValueError):
        quality.report(df, [{"type": "nope"}])


def test_empty_batch_passes(spark):
    df = spark.createDataFrame([], "id int, v double, ts timestamp")
    found = quality.report(df, [{"type": "null_ratio_check", "column": "v"}, {"type": "freshness_check", "column": "ts"}, {"type": "row_count_match", "expected": 0}])
    assert not any(r.violated for r in found.collect())


def test_row_by_row_application_gives_the_same_tables(spark):
    r = random.Random(7)
    table = [(k, float(k)) for k in range(0, 20, 2)]
    events = [(r.randrange(20), i, r.choice("cud"), float(r.randrange(100))) for i in range(60)]
    t = spark.createDataFrame(table, "k int, v double")
    e = changes.compact(spark.createDataFrame(events, "k int, seq int, op string, v double"), ["k"], ["seq"])
    last = {x[0]: x for x in events}
    scd1, merged = dict(table), dict(table)
    for k, _, op, v in last.values():
        scd1.pop(k, None)
        if op != "d":
            scd1[k] = v
        if (op == "u" and k in merged) or (op == "c" and k not in merged):
            merged[k] = v
        elif op == "d":
            merged.pop(k, None)
    assert dict(rows(apply.scd1(t, e, ["k"]))) == scd1
    assert dict(rows(apply.merge(t, e, ["k"]))) == merged


def test_sync_needs_keys(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError):
        apply.sync("incremental", df, df, ["b"])


def test_replace_swaps(spark, tmp_path):
    path = f"{tmp_path}/t"
    for n in (3, 5):
        apply.replace(spark.range(n).toDF("id"), path)
        assert spark.read.parquet(path).count() == n
    apply.replace(spark.read.parquet(path).where("id > 1"), path)
    assert spark.read.parquet(path).count() == 3


@settings(max_examples=100, deadline=None)
@given(st.integers(-50, 50), st.integers(0, 200), st.integers(1, 20))
def test_ranges_cover_every_key_once(lo, span, k):
    found = ranges.split(lo, lo + span, k)
    for key in range(lo - 2, lo + span + 3):
        assert sum((a is None or key > a) and (b is None or key <= b) for a, b in found) == 1


def test_evolve_and_names(spark):
    old, new = spark.createDataFrame([], "a int, b string").schema, spark.createDataFrame([], "a bigint, c date").schema
    schema, found = schemas.evolve(old, new)
    assert schema.simpleString() == "struct<a:bigint,b:string,c:date>" and found == [("a", "widened", "int", "bigint"), ("c", "added", None, "date")]
    assert clean.unique_names(["a", "A", "a_1", "b"]) == ["a", "A_2", "a_1", "b"]
    assert schemas.patch_spec({"transforms": [{"type": "cast", "column": "a", "to_type": "int"}]}, "a", "type_changed", "long")["transforms"][0]["to_type"] == "long"


def test_stream_runs_the_batch_operators(spark, tmp_path):
    spark.createDataFrame([(i, str(i)) for i in range(10)], "id int, v string").write.parquet(f"{tmp_path}/in")
    source = runner.file_events(spark, f"{tmp_path}/in", "id int, v string")
    spec = {"transforms": [{"type": "cast", "column": "v", "to_type": "int"}]}
    policy = {"rules": [{"type": "range_check", "column": "v", "max": 6}], "on_fail": "block"}
    sink = lambda df, n: df.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}")
    runner.start(source, lambda: spec, policy, sink, f"{tmp_path}/check", f"{tmp_path}/dead").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 7
    assert spark.read.parquet(f"{tmp_path}/dead").count() == 3


def test_event_log(spark, tmp_path):
    lines = "".join(json.dumps({"op": "c", "pk": {"id": i}, "after": {"id": i}, "ts_ms": i}) + "\n" for i in range(4))
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "1.jsonl").write_text(lines + "broken\n")
    read = lambda name, starting="earliest": (runner.to_table(runner.log_events(spark, f"{tmp_path}/log", starting), f"{tmp_path}/{name}", f"{tmp_path}/{name}-check"), spark.read.parquet(f"{tmp_path}/{name}"))[1]
    got = read("all")
    assert rows(got.where("line IS NULL").select("ts_ms", F.get_json_object("after", "$.id"))) == [(i, str(i)) for i in range(4)]
    assert rows(got.where("line IS NOT NULL").select("line")) == [("broken",)]
    assert read("new", datetime(2999, 1, 1)).count() == 0
    with pytest.raises(ValueError):
        read("newest", "latest")
    (tmp_path / "log" / "2.jsonl").write_text(lines)
    assert read("all").count() == 9  # what was read before is not read again


def test_pipeline_is_read_again_for_each_batch(spark, tmp_path):
    for i in range(2):
        spark.createDataFrame([(i, "7")], "id int, v string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    specs = iter([{"transforms": []}, {"transforms": [{"type": "string_op", "column": "v", "op": "concat", "suffix": "!"}]}])
    source, out = runner.file_events(spark, f"{tmp_path}/in", "id int, v string", max_files=1), []
    runner.start(source, lambda: next(specs), None, lambda df, n: out.extend(r.v for r in df.collect()), f"{tmp_path}/check").awaitTermination()
    assert out == ["7", "7!"]


def test_a_failing_sink_is_tried_again_and_then_its_batch_is_set_aside(spark, tmp_path):
    df, pauses, seen = spark.range(3).toDF("id"), [], []

    def sink(batch, number, bad=3):
        seen.append(number)
        if len(seen) <= bad:
            raise OSError("away")

    runner.retried(sink, 4, 1.0, 3.0, sleep=pauses.append, chance=lambda: 0.5)(df, 7)
    assert seen == [7] * 4 and pauses == [1.0, 2.0, 3.0]
    with pytest.raises(OSError):
        runner.retried(lambda *_: sink(*_, bad=99), 2, sleep=pauses.append)(df, 8)
    runner.retried(lambda *_: sink(*_, bad=99), 2, sleep=pauses.append, dead_letters=f"{tmp_path}/dead")(df, 9)
    dead = spark.read.parquet(f"{tmp_path}/dead").collect()
    assert len(dead) == 3 and all("away" in r.reason and r.batch == 9 for r in dead)


class Folders:
    """Folders by name, and renames that may fail."""

    def __init__(self, held, bad):
        self.held, self.bad = set(held), bad

    def exists(self, path):
        return path in self.held

    def delete(self, path, _):
        self.held.discard(path)

    def rename(self, a, b):
        if (a, b) in self.bad or a not in self.held:
            return False
        self.held.remove(a)
        self.held.add(b)
        return True


def test_a_failed_swap_loses_no_table():
    fine = Folders({"new", "t"}, [])
    apply.swap(fine, "new", "t", "old")
    assert fine.held == {"t"}
    stuck = Folders({"new", "t"}, [("t", "old")])
    with pytest.raises(OSError):
        apply.swap(stuck, "new", "t", "old")
    assert stuck.held == {"t"}
    back = Folders({"new", "t"}, [("new", "t")])
    with pytest.raises(OSError):
        apply.swap(back, "new", "t", "old")
    assert "t" in back.held and "old" not in back.held


def test_small_files_are_rewritten(spark, tmp_path):
    spark.range(100).repartition(10).write.parquet(f"{tmp_path}/t")
    assert apply.compact(spark, f"{tmp_path}/t") == {"before": 10, "after": 1, "rewritten": 10}
    held = spark.read.parquet(f"{tmp_path}/t")
    assert held.count() == 100 and len(held.inputFiles()) == 1


def test_first_batches_follow_their_mode(spark):
    batch = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, at int, v string")
    assert rows(apply.sync("incremental", None, batch, ["k"], "at")) == [(1, 2, "b"), (2, 1, "c")]
    assert "loaded_at" in apply.sync("full_refresh_append", None, batch).columns
    events = batch.select("k", "v", F.lit("u").alias("op"), F.timestamp_seconds("at").alias("valid_from"))
    got = apply.sync("cdc", None, events, ["k"])
    assert got.columns == ["k", "v", "valid_from", "valid_to", "is_deleted"] and got.where("valid_to IS NULL").count() == 2
    with pytest.raises(ValueError):
        apply.sync("incremental", None, batch, ["nope"])
    with pytest.raises(ValueError):
        apply.write("nope", None, batch)
    twice = batch.unionByName(batch)
    assert rows(apply.write("upsert", None, twice, ["k"])) == [(1, 2, "b"), (2, 1, "c")]


def test_late_events_never_overlap(spark):
    r = random.Random(3)
    events = [(k, r.randrange(1, 40), r.choice("cuud"), i) for k in range(20) for i in range(8)]
    kinds = "k int, at int, op string, v int"
    df = lambda x: spark.createDataFrame(x, kinds).select("k", "v", "op", F.timestamp_seconds("at").alias("valid_from"))
    unique = list({(k, at): (k, at, op, i) for k, at, op, i in events}.values())
    once = apply.scd2(apply.empty("cdc_incremental_deduped_history", df(unique)), df(unique), ["k"])
    r.shuffle(unique)
    held = apply.empty("cdc_incremental_deduped_history", df(unique))
    for i in range(0, len(unique), 40):
        held = spark.createDataFrame(apply.scd2(held, df(unique[i : i + 40]), ["k"]).collect(), held.schema)
    # Late batches give what all events at once give, but for deletes of what was not there yet.
    spans = {}
    for k, v, a, b, _ in rows(held):
        spans.setdefault(k, []).append((a, b))
    for s in spans.values():
        s.sort()
        assert all(x[1] is not None and x[1] <= y[0] for x, y in zip(s, s[1:], strict=False))
    assert {x[:3] for x in rows(held)} == {x[:3] for x in rows(once)}


def test_routes(spark):
    events = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "*", "*"), (4, None, "x")], "id int, schema_name string, table_name string")
    routes = spark.createDataFrame([("a", "x", "one"), ("*", "x", "two"), ("*", "*", "three"), ("a", "*", "never")], "route_schema string, route_table string, target string")
    assert rows(changes.route(events, routes).select("id", "target")) == sorted([(1, "one"), (1, "two"), (1, "three"), (2, "two"), (2, "three"), (3, "three"), (4, "two"), (4, "three")], key=str)


def test_connections_stay_in_order(spark):
    df = spark.createDataFrame([(f"c{i % 3}", 100 - i) for i in range(60)], "source_id string, lsn int")
    seen = changes.in_order(df).withColumn("part", F.spark_partition_id()).collect()
    for c in ("c0", "c1", "c2"):
        own = [(r.part, r.lsn) for r in seen if r.source_id == c]
        assert len({p for p, _ in own}) == 1 and own == sorted(own)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_overlaps_like_brute_force(spark, seed):
    r = random.Random(seed)
    files = []
    for i in range(60):
        lo = r.choice([None, *range(0, 100, 3)])
        files.append((i, lo, None if r.random() < 0.1 else (lo or 0) + r.choice([1, 5, 40])))
    low, high = (lambda x: -1e9 if x is None else x), (lambda x: 1e9 if x is None else x)
    want = sorted((a, b, low(c) >= low(lo) and high(d) <= high(hi)) for a, lo, hi in files for b, c, d in files if a < b and low(lo) < high(d) and low(c) < high(hi))
    got = ranges.overlaps(spark.createDataFrame(files, "path int, lo int, hi int"))
    assert sorted(tuple(x) for x in got.select("a", "b").collect()) == [x[:2] for x in want]
    contained = {(a, b) for a, b, c in got.collect() if c}
    assert contained == {(a, b) for a, b, _ in want if (files[a][1] is None or (files[b][1] is not None and files[b][1] >= files[a][1])) and (files[a][2] is None or (files[b][2] is not None and files[b][2] <= files[a][2]))}


def test_positions_and_averages_like_a_loop(spark, monkeypatch):
    monkeypatch.setattr(sweep, "PART_ROWS", 7)
    r = random.Random(5)
    data = [(r.choice(["a", "b", None]), i, float(r.randrange(50))) for i in range(100)]
    r.shuffle(data)
    df = spark.createDataFrame(data, "g string, i int, v double")
    want = {}
    for g, _, v in sorted(data, key=lambda x: x[1]):
        want[g] = v if g not in want else want[g] * 0.7 + v * 0.3
    got = {x.g: x.ema for x in metrics.moving_average(df, ["g"], "i", "v").collect()}
    assert got.keys() == want.keys() and all(abs(got[g] - want[g]) < 1e-9 for g in want)
    assert sorted(x.page for x in logs.pages(df, "i", 30).collect()) == sorted(i // 30 for i in range(100))


def test_one_flag_for_each_reference(spark):
    df, ref = spark.createDataFrame([(1,), (2,), (None,)], "a int"), lambda *x: spark.createDataFrame([(i,) for i in x], "a int")
    rules = [{"type": "referential_integrity", "column": "a", "reference": ref(9)}, {"type": "referential_integrity", "column": "a", "reference": ref(1, 2)}]
    assert [r.failing for r in quality.report(df, rules).orderBy("rule").collect()] == [2, 0]
    with pytest.raises(ValueError):
        quality.by_action(df, [{"type": "null_check", "column": "a", "action": "nope"}])


def test_jdbc(spark):
    url = "jdbc:derby:memory:tidemark;create=true"
    spark.range(100).selectExpr("CAST(id AS INT) AS ID", "CAST(id * 2 AS INT) AS V").write.jdbc(url, "t", mode="overwrite")
    parts = logs.jdbc(spark, url, "t", ranges.predicates("id", ranges.split(0, 99, 4)))
    assert parts.rdd.getNumPartitions() == 4 and parts.count() == 100
    later = logs.jdbc(spark, url, "t", cursor="V", mark="150")
    assert later.count() == 25 and "PushedFilters: [*IsNotNull(V), *GreaterThanOrEqual(V,150)]" in later._jdf.queryExecution().toString()
    assert logs.jdbc_query(spark, url, "SELECT COUNT(*) AS n FROM t WHERE id < 10").first()[0] == 10
    assert "pg_class" in logs.estimate_query("postgresql", "s", "t")
    with pytest.raises(ValueError):
        logs.estimate_query("mysql", "s; DROP", "t")


def test_documents_with_unknown_watermarks_are_read_whole(spark):
    df = spark.createDataFrame([(("x",), 1, 2), (("y",), 3, 4)], "_id struct<oid string>, a int, A int")
    assert rows(logs.documents(df, "a", "no time")) == [("x", 1, 2), ("y", 3, 4)] and logs.documents(df).columns == ["_id", "a", "A_1"]
