import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import repeats


def brute(rows):
    seen, out, placed = {}, [], []
    for i, (key, text) in sorted(enumerate(rows), key=lambda x: (x[1][0] is None, x[1][0] or 0, hashlib.sha256((x[1][1] or "").encode()).hexdigest(), x[0])):
        placed.append((key, (text or "").encode()))
    for key, data in placed:
        cover = np.zeros(len(data), bool)
        for s in range(len(data) - 99):
            w = data[s : s + 100]
            if w in seen:
                cover[s : s + 100] = True
            else:
                seen[w] = True
        kept = bytes(b for b, c in zip(data, cover) if not c)
        spans = int(cover[:1].sum() + (cover[1:] & ~cover[:-1]).sum()) if len(data) else 0
        out.append((key, len(data), int(cover.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_repeats_match_brute_force(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeé ") for _ in range(6))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(40) for _ in range(6)]
    rows = []
    for i in range(150):
        parts = [text(r.randrange(1, 30)) for _ in range(r.randrange(1, 4))]
        if r.random() < 0.6:
            parts.insert(r.randrange(len(parts) + 1), r.choice(shared)[r.randrange(40) :])
        rows.append((i, r.choice(["", "\n"]).join(parts)))
    rows += [(200 + i, rows[i][1]) for i in range(0, 60, 7)]
    rows += [(300, None), (301, ""), (302, "ab" * 400), (303, "x" * 99), (304, "x" * 100), (305, "x" * 5000), (None, shared[0] * 2), (None, shared[0] * 2), (5, text(80)), (5, shared[1] + text(60)), (400, rows[3][1]), (400, rows[3][1])]
    r.shuffle(rows)
    docs = spark.createDataFrame([(k, t, "c") for k, t in rows], "doc_id long, text string, doc string")
    got = sorted((tuple(x) for x in repeats.repeats(docs).collect()), key=str)
    assert got == brute(rows)


def longest(data, at, position):
    """Previous factors by comparing every start with every one of a smaller position."""
    common = lambda a, b: next((i for i in range(100) if data[a + i] != data[b + i]), 100)
    return [max([common(a, b) for b, q in zip(at, position, strict=True) if q < p], default=0) for a, p in zip(at, position, strict=True)]


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 1 << 30), st.integers(1, 4), st.booleans())
def test_factors_like_brute_force(seed, kinds, collide):
    r = np.random.default_rng(seed)
    parts = [r.integers(0, 2, 40).astype(np.uint8) for _ in range(kinds)]
    data = np.concatenate([parts[i] for i in r.integers(0, kinds, 6)] + [r.integers(0, 3, 20).astype(np.uint8)])
    at = np.sort(r.choice(len(data) - 99, min(40, len(data) - 99), replace=False))
    position = r.permutation(len(at)) * 3 // 4
    mark = np.array([0 if collide else hash(data[a : a + 100].tobytes()) & (1 << 62) - 1 for a in at], np.uint64)
    assert repeats.factors(data, at, position, mark).tolist() == longest(data, at, position)


def test_fingerprint_collisions_are_settled_by_bytes():
    data = np.frombuffer(b"a" * 100 + b"b" * 100 + b"a" * 100, np.uint8)
    at = np.array([0, 100, 200])
    got = repeats.factors(data, at, at, np.zeros(3, np.uint64)) >= 100
    assert got.tolist() == [False, False, True]


def test_strings_known_to_a_task_are_not_sent_again():
    data = np.frombuffer(b"a" * 100 + b"b" * 100, np.uint8)
    view, known = np.lib.stride_tricks.sliding_window_view(data, 100), repeats._Known(most=1)
    keys = lambda i: tuple(np.array([v]) for v in (i, 0, 0))
    mark = np.array([7], np.uint64)
    known.add(view, np.array([0]), mark, keys(5))
    known.add(view, np.array([100]), mark + np.uint64(1), keys(5))  # there is no room
    found = lambda at, i: known.earlier(view, np.array([at]), mark, keys(i)).tolist()
    assert found(0, 6) == [True] and found(0, 5) == [False] and found(0, 4) == [False] and found(100, 6) == [False] and len(known.mark) == 1


def test_repeats_of_nothing(spark):
    assert repeats.repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeated_rows_stand_for_each_other(spark, monkeypatch):
    """Rows of one id and one text are looked at once: no start of theirs is sent."""
    sent = []
    plain = repeats._ship
    monkeypatch.setattr(repeats, "_ship", lambda groups: sent.append(groups) or plain(groups))
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(None, text)] * 40 + [(7, text)] + [(i + 10, f"{i} {text[:150]}") for i in range(3)]
    got = sorted((tuple(x) for x in repeats.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == brute(rows) and sent


def test_a_task_holds_the_arrays_of_one_slice():
    r = np.random.default_rng(3)
    texts = [r.integers(97, 123, 500_000, dtype=np.uint8).tobytes().decode() for _ in range(12)]
    texts[6:] = [t[:1000] + t[2000:] for t in texts[:6]]
    ids = pa.array(range(12), pa.int64())
    files = pa.concat_tables(map(pa.Table.from_batches, ([b] for b in repeats._files(iter([pa.record_batch([ids, pa.array(texts)], ["doc", "text"])])))))
    marks = [files.filter(pc.equal(files["doc"], i))["file"].to_pylist() for i in range(12)]
    rows = pa.record_batch([ids, ids, ids, pa.array(texts), pa.array(marks, pa.list_(pa.int64()))], ["doc", "id", "tie", "text", "files"])
    for work in (repeats._files, repeats._ship(8)):
        tracemalloc.start()
        count = sum(out.num_rows for out in work(iter([rows])))
        _, most = tracemalloc.get_traced_memory()
        tracemalloc.stop()
        assert count and most < 150e6, work
