import zlib

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import charlm, langid, quality, queries

DIR = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    found = queries.op9_language_id(spark, DIR)
    docs = queries.table(spark, DIR, "documents")
    assert found.count() == docs.count()
    held = found.where("held_out").join(docs.where("lang IS NOT NULL AND length(text) >= 20").select("doc_id", "lang"), "doc_id")
    right = held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98
    assert found.where("score NOT BETWEEN 0 AND 1 OR score IS NULL").isEmpty()


def test_language_edge_cases(spark):
    rows = [(i, "the cat and the dog went home", "en") for i in range(4)] + [(i, "der hund und die katze gehen", "de") for i in range(4, 8)]
    rows += [(8, None, "en"), (9, "", None), (10, "12 34 !?", "en"), (11, "the dog", None), (None, "die katze", None), (11, "the dog", None), (12, "und die " * 30000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("label", F.lit("no"))
    got = langid.identify(df, F.lit(True), keep=[F.col("doc_id")]).collect()
    assert len(got) == len(rows)
    pred = {r["doc_id"]: r["lang_pred"] for r in got}
    assert [pred[i] for i in (0, 4, 8, 9, 10, 11, None, 12)] == ["en", "de", "und", "und", "und", "en", "de", "de"]
    empty = langid.identify(df.limit(0), F.lit(True), keep=[F.col("doc_id")])
    assert empty.collect() == []


def test_prediction_does_not_read_the_language_column(spark):
    rows = [(i, "the cat and the dog went home", "en") for i in range(4)] + [(i, "der hund und die katze gehen", "de") for i in range(4, 8)]
    rows += [(8, "the dog went", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(df, F.col("doc_id") < 8, keep=[F.col("doc_id")]).where("doc_id = 8").first()
    assert got["lang_pred"] == "en"


def test_quality_keeps_good_and_rejects_bad(spark):
    docs, labels = queries.table(spark, DIR, "documents"), queries.table(spark, DIR, "labels")
    found = quality.classify(docs, labels, [F.col("doc_id")])
    assert found.count() == docs.count()
    known = found.join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("accepted").cast("int")).alias("kept"))
    kept = {r["quality"]: r["kept"] for r in known.collect()}
    assert kept[1] > 0.98 and kept[0] < 0.5


def test_quality_edge_cases(spark):
    rows = [(i, "the cat and the dog went home to the house", "en") for i in range(60)]
    rows += [(60, None, "en"), (61, "", None), (None, "the dog", "xx"), (62, "the dog went home", None), (62, "the dog went home", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("id", F.lit(1))
    labels = spark.createDataFrame([*((i, 1, 0) for i in range(59)), (59, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels, [F.col("doc_id"), F.col("id")]).collect()
    assert len(got) == len(rows) and all(isinstance(r["accepted"], bool) for r in got)
    assert quality.classify(docs.limit(0), labels, [F.col("doc_id")]).collect() == []
    assert quality.classify(docs, labels.limit(0), [F.col("doc_id")]).count() == len(rows)


def test_letters_of_any_script_stay_apart(spark):
    words = {"aa": "абвг дежз ийкл", "bb": "щшчц хфут српо", "cc": "òò öö ùù", "dd": "üü óó úú", "ee": "𐐀𐐁 𐐂𐐃 𐐄𐐅", "ff": "𐑀𐑁 𐑂𐑃 𐑄𐑅"}
    rows = [(i * 10 + j, t, lang) for i, (lang, t) in enumerate(words.items()) for j in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(df, F.lit(True), keep=[F.col("doc_id"), F.col("lang")]).collect()
    assert len(got) == len(rows) and all(r["lang"] == r["lang_pred"] for r in got)


def brute_cost(taught, text, order):
    """Mean -log p of the characters of text under a model of the taught texts, by counting all n-grams in plain Python."""
    levels = [{} for _ in range(order)]
    pad = " " * (order - 1)
    for t in taught:
        for g in ((pad + t)[i : i + order] for i in range(len(t))):
            levels[-1][g] = levels[-1].get(g, 0) + 1
    for k in reversed(range(order - 1)):
        for g in levels[k + 1]:
            levels[k][g[1:]] = levels[k].get(g[1:], 0) + 1
    size = len({g for t in taught for g in t}) + 1  # and one for all that is not known

    def p(g):
        if not g:
            return 1 / size
        level = levels[len(g) - 1]
        of = [max(1, sum(c == i for c in level.values())) for i in (1, 2, 3, 4)]
        y = of[0] / (of[0] + 2 * of[1])
        d = [0, *(min(max(i - (i + 1) * y * of[i] / of[i - 1], 0.1), top) for i, top in ((1, 0.95), (2, 1.9), (3, 2.9)))]
        after = [c for h, c in level.items() if h[:-1] == g[:-1]]
        n = level.get(g, 0)
        return (n - d[min(n, 3)]) / sum(after) + sum(d[min(c, 3)] for c in after) / sum(after) * p(g[1:]) if after else p(g[1:])

    return -sum(np.log(p((pad + text)[i : i + order])) for i in range(len(text))) / max(1, len(text))


def test_costs_match_a_count_of_all_ngrams(spark):
    taught, asked = ["абаб ába", "ab абв"], ["абв ab", "щ", "", "𐐀б 𐐀"]
    rows = spark.createDataFrame([(t, (i,)) for i, t in enumerate(asked)], "text string, row struct<i: int>")
    labels, found = charlm.scored(spark.createDataFrame([("x", t) for t in taught], "label string, text string"), rows, 3)
    assert labels == ["x"]
    for r in found.collect():
        t = asked[r["row"]["i"]]
        assert r["chars"] == len(t) and abs(r["costs"][0] - brute_cost(taught, t, 3)) < 1e-6  # the table holds 32-bit floats


def test_many_shards_change_no_cost(spark, monkeypatch):
    """A table in many shards gives what one gives."""
    r = np.random.default_rng(2)
    texts = ["".join(r.choice(list("abcd é"), r.integers(0, 30))) for _ in range(40)]
    rows = spark.createDataFrame([(t, (i,)) for i, t in enumerate(texts)], "text string, row struct<i: int>").coalesce(2)
    taught = spark.createDataFrame([(str(i % 2), t) for i, t in enumerate(texts[:20])], "label string, text string")
    monkeypatch.setattr(charlm, "SHARD", 5)
    labels, found = charlm.scored(taught, rows, 3)
    for x in found.collect():
        for label, cost in zip(labels, x["costs"], strict=True):
            want = brute_cost([t for i, t in enumerate(texts[:20]) if str(i % 2) == label], texts[x["row"]["i"]], 3)
            assert abs(cost - want) < 1e-6


def test_answering_tasks_follow_the_text():
    assert [charlm.copied(n, 8) for n in (1, 8 * charlm.ASKING, 16 * charlm.ASKING, 8000)] == [1, 1, 2, 1000 // charlm.ASKING]


def test_copied_shards_change_no_cost(spark, monkeypatch):
    r = np.random.default_rng(5)
    texts = ["".join(r.choice(list("abcd é"), r.integers(0, 30))) for _ in range(60)]
    rows = spark.createDataFrame([(t, (i,)) for i, t in enumerate(texts)], "text string, row struct<i: int>")  # in as many partitions as the session has tasks
    taught = spark.createDataFrame([("x", t) for t in texts[:20]], "label string, text string")
    plain = {x["row"]["i"]: x["costs"] for x in charlm.scored(taught, rows, 3)[1].collect()}
    monkeypatch.setattr(charlm, "copied", lambda *_: 3)
    assert {x["row"]["i"]: x["costs"] for x in charlm.scored(taught, rows, 3)[1].collect()} == plain and len(plain) == 60


def test_slices_and_chunks_hold_every_row_once():
    import pyarrow as pa

    batches = [pa.record_batch([pa.array(["a" * n for n in part], pa.string())], ["text"]) for part in ([3, 0, 7], [], [50, 1], [2, 2])]
    old = charlm.SLICE, charlm.CHUNK
    charlm.SLICE, charlm.CHUNK = 5, 12
    try:
        got = list(charlm.chunked(iter(batches)))
    finally:
        charlm.SLICE, charlm.CHUNK = old
    assert [len(t) for b in got if b is not None for t in b.column("text").to_pylist()] == [3, 0, 7, 50, 1, 2, 2]
    assert got[-1] is None and sum(b is None for b in got) == 2


def test_perplexity_and_thresholds_like_brute_force(spark):
    r = np.random.default_rng(4)
    words = ["haus", "baum", "katze", "hund", "und", "der"]
    rows = [(i, " ".join(r.choice(words, r.integers(1, 12))), "de") for i in range(60)] + [(100, "zzqx qqzz xxqz", "de"), (101, "haus baum", "de"), (101, "haus baum", "de"), (102, "der hund " * 30000, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    half = lambda i: zlib.crc32(str(i).encode()) % 2
    taught = {h: [t for i, t, _ in rows if i < 60 and half(i) == h] for h in (0, 1)}
    got = quality.classify(docs, labels, [F.col("doc_id"), F.col("text")]).collect()
    assert len(got) == len(rows)
    for x in got:
        if x["doc_id"] != 102:
            assert abs(np.log(x["perplexity"]) - brute_cost(taught[1 - half(x["doc_id"])], x["text"], quality.ORDER)) < 1e-5
        assert x["accepted"] == (x["low"] <= x["perplexity"] <= x["high"])
    assert not next(x["accepted"] for x in got if x["doc_id"] == 100)
    assert len({(x["perplexity"], x["accepted"]) for x in got if x["doc_id"] == 101}) == 1


def test_language_of_least_cost_like_brute_force(spark):
    taught = {"de": ["der hund und die katze", "das haus und der baum"], "en": ["the dog and the cat", "the house and the tree"]}
    asked = ["und der hund", "the cat and", "a", "haus", "dog tree", "nothing known here"]
    rows = [(i, t, lang) for lang, ts in taught.items() for i, t in enumerate(ts)] + [(10 + i, t, None) for i, t in enumerate(asked)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = {r["text"] for r in df.where(F.pmod(F.xxhash64("text"), F.lit(langid.CALIBRATION)) == 0).collect()}
    teach = {k: [t for t in v if t not in held] or v for k, v in taught.items()}
    for r in langid.identify(df, F.lit(True), keep=[F.col("doc_id"), F.col("text"), F.lit(1).alias("margin"), F.lit(2).alias("letters")]).where("doc_id >= 10").collect():
        costs = {k: brute_cost(v, r["text"], langid.ORDER) for k, v in teach.items()}
        assert r["lang_pred"] == min(sorted(costs), key=costs.get) and r["margin"] == 1 and r["letters"] == 2


def test_languages_that_tie_go_by_the_first(spark):
    rows = [(1, "abc abd", "yy"), (2, "abc abd", "xx"), (3, "abc", None)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), keep=[F.col("doc_id")])
    assert {r["lang_pred"] for r in got.collect()} == {"xx"}


def test_thresholds_change_smoothly_with_a_languages_documents(spark):
    def bounds(n):
        rows = [("en", 2.0 + i % 10 / 10, 100) for i in range(200)] + [("xx", 5.0 + i % 10 / 10, 100) for i in range(n)]
        df = spark.createDataFrame([(f"{i}", *r) for i, r in enumerate(rows)], "id string, lang string, cost double, chars long")
        got = quality._judged(df.withColumn("kept", F.struct("lang")), df).where("lang = 'xx'").first()
        return np.log(got["low"]), np.log(got["high"])

    a, b = bounds(49), bounds(50)
    assert all(abs(x - y) < 0.1 for x, y in zip(a, b, strict=True))


def test_thresholds_like_brute_force(spark):
    r = np.random.default_rng(7)
    known = [(str(i), r.choice(["en", "fr", None], p=[0.7, 0.2, 0.1]), float(r.normal(2, 0.3)), int(r.choice([5, 40, 300]))) for i in range(700)]
    known = [(i, None if lang == "None" else lang, c, n) for i, lang, c, n in known]
    df = spark.createDataFrame(known, "id string, lang string, cost double, chars long").withColumn("kept", F.struct("id"))
    asked = [("a", "en", 2.0, 40), ("b", "fr", 2.0, 300), ("c", None, 2.0, 5), ("d", "zz", 2.0, 40), ("e", "fr", 2.0, 100_000)]
    at = lambda xs, q: sorted(xs)[max(0, int(np.ceil(q * len(xs))) - 1)]
    size = lambda n: int(np.log2(n))
    whole = np.mean([c for *_, c, _ in known])

    def drawn(own, wider, n):
        return (n * own + quality.WEIGHT * wider) / (n + quality.WEIGHT) if n else wider

    def centre(lang):
        own = [c for _, x, c, _ in known if x == lang and lang is not None]
        return drawn(np.mean(own) if own else 0, whole, len(own))

    away = [(x, size(n), c - centre(x)) for _, x, c, n in known]
    got = {x["id"]: x for x in quality._judged(spark.createDataFrame(asked, "id string, lang string, cost double, chars long").withColumn("kept", F.struct("id")), df).collect()}
    for i, lang, _, n in asked:
        cell = [d for x, k, d in away if x == lang and lang is not None and k == size(n)]
        same = [d for _, k, d in away if k == size(n)]
        for name, q in (("low", quality.LOW), ("high", quality.HIGH)):
            wide = drawn(at(same, q) if same else 0, at([d for *_, d in away], q), len(same))
            want = centre(lang) + drawn(at(cell, q) if cell else 0, wide, len(cell))
            assert abs(np.log(got[i][name]) - want) < 1e-9, (i, name)


def test_short_junk_gets_no_flat_slack(spark):
    rows = [(f"{i}", "en", 2.0 + i % 10 / 1000, 20) for i in range(500)]
    df = spark.createDataFrame(rows, "id string, lang string, cost double, chars long").withColumn("kept", F.struct("id"))
    odd = spark.createDataFrame([("x", "en", 2.5, 20), ("y", "en", 2.004, 20)], "id string, lang string, cost double, chars long").withColumn("kept", F.struct("id"))
    assert {r["id"]: r["accepted"] for r in quality._judged(odd, df).collect()} == {"x": False, "y": True}
