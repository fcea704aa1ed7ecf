import random
import re
import time
import tracemalloc
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
import numpy as np
import pyarrow as pa

from tidemark.llm import ngram_join, trie
from tidemark.llm.components import components
from tidemark.llm.workspace import stored


def brute(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i in range(len(rows)):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and sets[j]]
        out.append((rows[i][0], len(sets[i]), min(x for x in ids if x is not None) if any(x is not None for x in ids) else rows[i][0]))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefghij") + str(r.randrange(300))
    base = [[word() for _ in range(r.randrange(3, 400))] for _ in range(12)]
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(260):
        w = list(r.choice(base)) if r.random() < 0.7 else [word() for _ in range(r.randrange(0, 200))]
        for _ in range(int(len(w) * r.choice([0, 0.01, 0.02, 0.04, 0.06]))):
            w[r.randrange(len(w))] = word()
        if r.random() < 0.3:
            w += passage
        rows.append((i, r.choice([" ", "\n", "  "]).join(w).upper() if r.random() < 0.1 else " ".join(w)))
    rows += [(900, None), (901, ""), (902, "One two"), (903, "one  TWO"), (None, "one two"), (904, rows[3][1]), (904, rows[3][1]), (905, "É é"), (906, "é é"), (907, "x " * 5000)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_join_finds_exactly_the_components(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, class int")
    got = ngram_join.join(docs).collect()
    assert sorted(((r.id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)


def test_join_of_nothing(spark):
    assert ngram_join.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sets(st.integers(0, 14), min_size=1, max_size=12), min_size=2, max_size=12, unique_by=frozenset))
def test_trie_answers_like_brute_force(sets):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    like = lambda a, b: 100 * len(a & b) >= 80 * len(a | b) and a & b
    found = {(i, int(j)) for i, q in trie.Trie(arrays).similar(arrays) for j in q}
    assert found == {(i, j) for i in range(len(sets)) for j in range(len(sets)) if like(sets[i], sets[j])}
    half = len(sets) // 2
    for left, right in ((arrays, None), (arrays[:half], arrays[half:])):
        pairs = [(i, j) for i in range(len(sets)) for j in range(i) if like(sets[i], sets[j]) and (right is None or (i < half) != (j < half))]
        assert joined(len(sets), trie.links(left, right)) == joined(len(sets), pairs)
        assert set(trie.links(left, right)) <= {*pairs, *((j, i) for i, j in pairs)}


def joined(n, links):
    root = list(range(n))
    for a, b in links:
        x, y = root[a], root[b]
        root = [min(x, y) if r in (x, y) else r for r in root]
    return root


@pytest.mark.parametrize("bounds", [(3, 50_000), (3, 5), (1024, 2)])
def test_groups_in_parts_and_by_key_lose_no_link(spark, monkeypatch, bounds):
    monkeypatch.setattr(ngram_join, "PART", bounds[0])
    monkeypatch.setattr(ngram_join, "GROUP", bounds[1])
    rows = corpus(3)
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)


def test_components(spark):
    links = [(1, 2), (3, 2), (3, 4), (10, 9), (5, 5)] + [(i, i + 1) for i in range(20, 60)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 9: 9, 10: 9} | {i: 20 for i in range(20, 61)}


def test_shuffle_files_go_when_a_table_is_stored(spark):
    dirs = [d.getPath() for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    held = lambda: {f for d in dirs for f in Path(d).glob("*/shuffle_*")}
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i % 7, 90))) for i in range(40)], "doc_id long, text string").repartition(3)
    before = held()
    rows = stored(docs.groupBy("text").count().repartition(2, "count"), "test-shuffles")
    for _ in range(50):
        if not (left := held() - before):
            break
        time.sleep(0.1)
    assert not left and rows.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"  # only while it is written


def test_a_worker_holds_nothing_large_between_tasks():
    batch = pa.record_batch([pa.array([1]), pa.array([" ".join(f"word{i}" for i in range(330_000))])], ["id", "text"])
    tracemalloc.start()
    for rows in ngram_join._sets(False)(iter([batch])):
        del rows
    now, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert now < 1 << 20


def test_a_task_holds_the_arrays_of_a_small_slice():
    texts = [" ".join(f"w{i * j % 9973}" for j in range(400)) for i in range(1, 700)]  # 1.6 MB
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["id", "text"])
    whole = ngram_join._set_rows(batch, True, b"")
    tracemalloc.start()
    rows = [b.column("class").to_pylist() for b in ngram_join._sets(True)(iter([batch]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(rows) > 4 and sum(rows, []) == whole.column("class").to_pylist()
    assert peak < 15e6
