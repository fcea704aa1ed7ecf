import hashlib
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.llm.exact_dedup import exact_dedup, fingerprints, keyed_state, located
from tidemark.llm.workspace import scratch

ROWS = [
    (1, "same text", "a"),
    (2, "same  text", "b"),
    (3, "same\ttext", None),
    (4, "sametext ", "c"),
    (5, None, "a"),
    (6, "", "a"),
    (7, " \n\r\x0b\x0c", "a"),
    (8, "Same text", "a"),
    (9, "é x", "a"),
    (10, "éx", "a"),
    (11, "long " * 20000, "a"),
    (12, "long" * 20000, "a"),
    (-3, "same  text", "z"),
]


def brute(rows):
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc_id))
    out = []
    for normal, held in groups.items():
        keep = min(held)[1]
        out += [(i, keep, len(held), i == keep, hashlib.sha256(normal.encode()).hexdigest()) for _, i in held]
    return sorted(out)


def found(df, **more):
    return sorted(tuple(r) for r in exact_dedup(df, **more).select("id", "keep_id", "group_size", "kept", "digest").collect())


@pytest.mark.parametrize("max_files", [None, 1])
def test_brute_force(spark, max_files):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, digest string").repartition(3)
    assert found(df, max_files=max_files) == brute(ROWS)


def test_colliding_digests_are_told_apart_by_bytes(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, keep string")
    got = found(df, digest=lambda normal: F.substring(F.sha2(normal, 256), 1, 1))
    assert [r[:4] for r in got] == [r[:4] for r in brute(ROWS)]


def test_repeated_rows_keep_one(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (2, "x")], "doc_id long, text string")
    got = found(df)
    assert [r[:3] for r in got] == [(1, 1, 3), (1, 1, 3), (2, 1, 3)] and sum(r[3] for r in got) == 1


def test_null_id_stays_only_alone(spark):
    df = spark.createDataFrame([(None, "x"), (2, "x"), (None, "y")], "doc_id long, text string")
    assert {(r["id"], r["keep_id"], r["kept"]) for r in exact_dedup(df).collect()} == {(None, 2, False), (2, 2, True), (None, None, True)}


@pytest.mark.parametrize("deal", [1, 2])
def test_groups_of_many_copies_are_dealt_out(spark, monkeypatch, tmp_path, deal):
    monkeypatch.setattr("tidemark.llm.exact_dedup.DEAL", deal)
    rows = [(i, "one text " + " " * (i % 3), None) for i in range(40)] + ROWS[7:]
    spark.createDataFrame(rows, "doc_id long, text string, _metadata string").repartition(3).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    assert sorted({r for r in found(df)}) == sorted(set(brute(rows)))
    twice = df.drop("_metadata").select("doc_id", F.explode(F.array("text", "text")).alias("text"))
    got = found(twice)
    assert len(got) == 2 * len(rows) and sum(r[3] for r in got) == sum(r[3] for r in brute(rows))
    got = found(df, digest=lambda normal: F.lit("same"))
    assert [r[:4] for r in got] == [r[:4] for r in brute(rows)]


def test_empty(spark):
    assert found(spark.createDataFrame([], "doc_id long, text string")) == []


def test_input_of_other_kinds_and_paths_read_twice(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (2, "ab"), (3, "c")], "doc_id long, text string")
    docs.write.json(f"{tmp_path}/json")
    docs.write.orc(f"{tmp_path}/orc")
    docs.coalesce(1).write.parquet(f"{tmp_path}/p")
    for df in (spark.read.schema(docs.schema).json(f"{tmp_path}/json"), spark.read.orc(f"{tmp_path}/orc"), spark.read.parquet(f"{tmp_path}/p")):
        assert {(r.id, r.keep_id, r.kept) for r in exact_dedup(df).collect()} == {(1, 1, True), (2, 1, False), (3, 3, True)}
    twice = exact_dedup(spark.read.parquet(f"{tmp_path}/p", f"{tmp_path}/p")).collect()
    assert len(twice) == 6 and sorted(r.id for r in twice if r.kept) == [1, 3] and {r.group_size for r in twice} == {4, 2}


def test_state_stores_are_closed_with_their_tasks(spark):
    docs = spark.createDataFrame([(i, f"text {i % 20}") for i in range(60)], "doc_id long, text string")
    fingerprints(located(docs, "doc_id", "text")).write.parquet(table := scratch(spark, "test-fingerprints"))
    env = spark._jvm.org.apache.spark.SparkEnv.get()
    local = spark._jvm.org.apache.spark.util.Utils.getLocalDir(env.conf())
    stores = lambda: {str(p) for p in Path(local).rglob("StateStoreId*")}  # noqa: E731  an open store's folder
    before = stores()
    state = keyed_state(spark, table, scratch(spark, "test-state"))
    assert stores() <= before
    assert sorted(r.group_size for r in state.collect()) == [3] * 20
