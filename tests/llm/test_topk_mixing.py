import hashlib
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing, topk


def brute_top(rows, asks, k):
    held = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            held[i] = [math.floor(1024 * float(np.float32(x))) for x in v]
    out = []
    for i, v in held.items():
        if asks(i):
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in held.items() if j != i)[:k]
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(best, 1)]
    return sorted(out)


def vectors(n, dims, seed=3):
    draw = random.Random(seed)
    rows = [(i, [draw.gauss(0, 1) for _ in range(dims)]) for i in range(n)]
    rows[7] = (7, None)
    rows[8] = (8, [float("nan")] * dims)
    rows[9] = (9, [None] + [1.0] * (dims - 1))
    rows[10] = (10, [float("inf")] + [1.0] * (dims - 1))
    for i in range(20, 40):
        rows[i] = (i, rows[20][1])  # ties
    return rows


@pytest.mark.parametrize("n,dims,k", [(300, 20, 10), (60, 3, 5), (50, 33, 100)])
def test_top_k_brute_force(spark, n, dims, k):
    rows = vectors(n, dims)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("v", F.lit(2))
    got = topk.top_k(df, F.col("vec_id") % 10 == 0, k).select("query_id", "rank", "vec_id", "score")
    assert sorted(map(tuple, got.collect())) == brute_top(rows, lambda i: i % 10 == 0, k)


def test_top_k_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    rows = vectors(200, 8, 5)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.top_k(df, F.col("vec_id") % 5 == 0, 7).select("query_id", "rank", "vec_id", "score")
    assert sorted(map(tuple, got.collect())) == brute_top(rows, lambda i: i % 5 == 0, 7)


def test_top_k_empty_and_alone(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(empty, F.col("vec_id") % 10 == 0).collect() == []
    alone = spark.createDataFrame([(0, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert topk.top_k(alone, F.col("vec_id") % 10 == 0).collect() == []


def copies_and_decay(n, dims, spread, seed):
    """Vectors whose mass sits in a few dimensions; some ids and some vectors come several times."""
    draw = np.random.default_rng(seed)
    m = np.floor(draw.normal(0, 1, (n, dims)) * spread * 0.7 ** np.arange(dims)).astype("i8")
    m[n // 2 :] = m[draw.integers(0, max(1, n // 4), n - n // 2)]
    ids = draw.permutation(n).astype("i8")
    ids[::7] = ids[3]
    return m, ids


def brute_block(q, query_ids, m, ids, k):
    out = []
    rows = sorted({(int(i), tuple(map(int, v))) for i, v in zip(ids, m, strict=True)})
    for own, v in zip(query_ids, q, strict=True):
        best = sorted((-sum(int(a) * b for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != own)[:k]
        out += [(int(own), i, max(-(1 << 63), min((1 << 63) - 1, -s))) for s, i in best]
    return sorted(out)


@pytest.mark.parametrize("spread,dims", [(300, 24), (3, 24), (1, 2), (1e5, 24), (1e9, 6), (1e15, 6), (5, 0)])
def test_search_of_a_block_is_exact(monkeypatch, spread, dims):
    """With and without bounds, for scores of 24, 53, 64 and more bits."""
    monkeypatch.setattr(topk, "FIRST", 32)
    monkeypatch.setattr(topk, "TILE", 40)
    monkeypatch.setattr(topk, "REST", 1)
    for n, k, seed in ((500, 10, 1), (200, 3, 2), (9, 10, 3), (300, 40, 4)):
        m, ids = copies_and_decay(n, dims, spread, seed)
        q, query_ids = m[: n // 4 + 1], ids[: n // 4 + 1]
        got = topk.search(q, query_ids, topk.Block(m, ids, topk._hashes(m), k), k)
        assert sorted(zip(*(x.tolist() for x in got), strict=True)) == brute_block(q, query_ids, m, ids, k)
        assert [x.tolist() for x in topk.search(q, query_ids, topk.Block(m, ids, np.zeros(n, "i8"), k), k)] == [x.tolist() for x in got]


def test_bounds_cut_dimensions():
    """Where mass sits in a few dimensions, the others are looked at for a few pairs only."""
    draw = np.random.default_rng(4)
    m = np.floor(draw.normal(0, 300, (6000, 32)) * 0.6 ** np.arange(32)).astype("i8")
    block = topk.Block(m, np.arange(6000), topk._hashes(m), 10)
    topk.search(m[:100], np.arange(100), block, 10)
    assert block._kept["d"] < 16


def test_top_k_of_large_numbers(spark):
    """Scores beyond 53 bits, lengths that differ, no dimension at all, ids that come with two vectors."""
    draw = random.Random(8)
    rows = [(i, [draw.gauss(0, 10 ** draw.choice([0, 3, 5])) for _ in range(draw.choice([0, 2, 5]))]) for i in range(120)]
    rows += [(i, [draw.gauss(0, 1e5), 1.0]) for i in range(0, 30, 3)] + [(10, rows[10][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    held = sorted({(i, tuple(math.floor(x * 1024) for x in v)) for i, v in rows})
    want = []
    for own in sorted({i for i, _ in held if i % 10 == 0}):
        pairs = [(-sum(a * b for a, b in zip(v, w, strict=True)), j) for i, v in held if i == own for j, w in held if j != own and len(v) == len(w)]
        want += [(own, rank, j, -s) for rank, (s, j) in enumerate(sorted(pairs)[:7], 1)]
    got = topk.top_k(df, F.col("vec_id") % 10 == 0, 7).select("query_id", "rank", "vec_id", "score")
    assert sorted(map(tuple, got.collect())) == want


def test_top_k_of_many_pairs_takes_seconds(spark):
    """1.2 thousand million pairs: a matrix product's work, where a loop over queries took most of a minute."""
    df = spark.range(200_000).select(F.col("id").alias("vec_id"), F.array(*[F.randn(d) * 0.125 for d in range(64)]).cast("array<float>").alias("embedding")).localCheckpoint()
    began = time.perf_counter()
    found = topk.top_k(df, F.col("vec_id") % 33 == 0, 10).agg(F.count("*").alias("n"), F.max("rank").alias("rank")).first()
    assert tuple(found) == (60_610, 10) and time.perf_counter() - began < 30


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        for s in over or open_:
            target[s] = 2.0 * sizes[s] if over else level * weight[s]
        left -= sum(2.0 * sizes[s] for s in over)
        open_ -= over or set(open_)
    return target


def corpus(seed):
    draw = random.Random(seed)
    rows = [(i, " ".join("w%d" % j for j in range(draw.choice([0, 1, 5, 40]))), draw.choice(["hot", "hot", "hot", "b", "c", None, "é", ""])) for i in range(400)]
    return [*rows, (400, None, "b"), (401, "only", "tiny"), (None, "x y", "b"), (5, "w0", "b"), (5, "w0", "b"), (402, "v " * 3000, "c")]


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_meets_targets(spark, seed):
    df = spark.createDataFrame(corpus(seed), "doc_id long, text string, source string").withColumn("key", F.lit("k")).withColumn("size", mixing.words(F.col("text")))
    got = mixing.mix(df).collect()
    assert len(got) == len(corpus(seed))
    sizes, taken, target = {}, {}, {}
    for r in got:
        assert r["size"] == len((r["text"] or "").split()) and 0 <= r["taken"] <= 2 * r["size"]
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
    want = brute_targets(sizes)
    assert target == pytest.approx(want) and {r["source"]: r["source_size"] for r in got} == sizes
    assert taken == {s: math.floor(t + 1e-9) for s, t in want.items()}
    again = mixing.mix(df.repartition(7)).collect()
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    assert sorted(map(key, again)) == sorted(map(key, got))


@pytest.mark.parametrize("hot", [1, 3])
def test_hot_ids_in_deals_take_what_a_loop_takes(spark, monkeypatch, hot):
    monkeypatch.setattr(mixing, "HOT", hot)
    monkeypatch.setattr(mixing, "RANGE_ROWS", 4)
    draw = random.Random(9)
    rows = [(draw.choice([None, None, 1, 2, i]), draw.choice(["a", "b", None]), draw.choice([0, 3, 7])) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long").withColumn("number", F.lit(1))
    sizes = {}
    for _, source, size in rows:
        sizes[source] = sizes.get(source, 0) + size
    want, target = [], brute_targets(sizes)
    for source, total in sizes.items():
        start, budget = 0, math.floor(target[source] + 1e-9)
        digest = lambda i: hashlib.md5(b"" if i is None else str(i).encode()).hexdigest()
        for i, size in sorted(((i, n) for i, s, n in rows if s == source), key=lambda x: (digest(x[0]), x[0] is not None, x[0] or 0, x[1])):
            epochs = budget // total
            want.append((i, source, size, epochs * size + max(0, min(size, budget - epochs * total - start))))
            start += size
    got = [(r["doc_id"], r["source"], r["size"], r["taken"]) for r in mixing.mix(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_drawn_holds_the_words_taken(spark):
    df = spark.createDataFrame(corpus(4), "doc_id long, text string, source string").withColumn("size", mixing.words(F.col("text")))
    mixed = mixing.mix(df)
    rows = mixing.drawn(mixed).select("source", mixing.words(F.col("text")).alias("n")).groupBy("source").sum("n").collect()
    want = mixed.groupBy("source").sum("taken").collect()
    assert {r[0]: r[1] for r in rows} == {r[0]: r[1] for r in want if r[1]}


def test_mix_empty_and_clash(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, size long")
    assert mixing.mix(empty).collect() == []
    with pytest.raises(ValueError, match="taken"):
        mixing.mix(empty.withColumn("taken", F.lit(1)))
