import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import queries
from tidemark.llm.tokens import encoder
from tidemark.llm.workspace import stored

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def runs(spark):
    """What every stage is given and returns, each written and reread as the next one's input."""
    docs, out = queries.table(spark, DIR, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, docs, DIR), "test-stage")
        out.append((name, docs, after))
        docs = after
    return out


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stages_return_the_columns_of_documents(runs):
    for _, before, after in runs[:-1]:
        assert after.columns == before.columns


def test_filters_keep_whole_rows(runs):
    for _, before, after in runs[:3]:
        assert set(rows(after)) <= set(rows(before)) and 0 < after.count() <= before.count()


def test_exact_copies_go_and_one_stays(runs):
    _, before, after = runs[1]
    squeeze = lambda df: [r[0] for r in df.select(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]", "")).collect()]
    assert sorted(squeeze(after)) == sorted(set(squeeze(before)))


def test_near_copies_go(runs):
    def sets(df):
        out = {}
        for r in df.collect():
            w = (r["text"] or "").lower().split()
            out[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
        return out

    def linked(a, b):
        return bool(a & b) and 100 * len(a & b) >= 80 * len(a | b)

    _, before, after = runs[2]
    held, left = sets(before), sets(after)
    assert not any(linked(left[x], left[y]) for x in left for y in left if x < y)
    for gone in held.keys() - left.keys():
        assert any(linked(held[gone], held[x]) for x in held if x != gone)


def test_packing_holds_every_id_of_the_mix_once(runs):
    _, before, after = runs[4]
    encode = encoder(queries.tokenizer_file("word_bpe_49k.json"))
    want = sum(len(encode.ids(r["text"])) // 4 + 1 for r in before.collect())
    assert after.agg(F.sum("length")).first()[0] == want
    over = after.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert over.where("n > 2048").isEmpty()
    one = before.orderBy(F.length("text").desc()).first()
    ids = encode.ids(one["text"]) + np.array([1], "<u4").tobytes()
    pieces = after.where(F.col("doc_id") == one["doc_id"]).where(F.col("doc_tokens") == len(ids) // 4).collect()
    assert pieces and all(p["ids_crc32"] == zlib.crc32(ids[4 * p["start"] : 4 * (p["start"] + p["length"])]) for p in pieces if before.where(F.col("doc_id") == one["doc_id"]).count() == 1)


def test_every_stage_takes_nulls_and_empty_tables(spark):
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(None, None, None, None, None), (None, "a b", None, None, None), (1, None, "en", "s", 0), (1, "a b", "en", "s", 3), (2, "", None, None, None), (3, "word " * 5000, "en", None, 1)]
    for given in (odd, []):
        docs = spark.createDataFrame(given, kinds)
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, docs, DIR)
            assert after.count() >= 0, name
            if name != corpus_pipeline.STAGES[-1][0]:
                assert after.columns == docs.columns


def test_columns_of_any_name_pass_through(spark):
    """Names that stages use themselves: the rows are those of a run without them, and what they hold stays."""
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    given = [(i, f"{'a b c d e f g ' * (i % 4 + 1)} {i % 6}", "en", f"s{i % 2}", i) for i in range(24)]
    docs = spark.createDataFrame(given, kinds)
    names = ["accepted", "taken", "target", "source_size", "size", "mix_size", "row_no", "row_key", "doc", "kept", "id", "class", "digest", "file", "chars", "costs"]
    more = docs.select("*", *[F.col("n_chars").alias(c) for c in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, more = stored(stage(spark, docs, DIR), "test-plain"), stored(stage(spark, more, DIR), "test-clash")
        assert more.columns == [*docs.columns, *names], name
        assert rows(more.select(*docs.columns)) == rows(docs), name
        assert more.where(" OR ".join(f"NOT {c} <=> n_chars" for c in names)).isEmpty(), name
    pack = corpus_pipeline.STAGES[-1][1]
    assert pack(spark, more, DIR).count() == pack(spark, docs, DIR).count()


def test_copies_of_null_and_repeated_ids_go(spark):
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    long = " ".join(f"w{i}" for i in range(60))
    near = long + " more"
    given = [(None, long, None, None, 1), (None, long, None, None, 2), (None, near, None, None, 3), (7, "a b c", None, None, 4), (7, "a  b c", None, None, 5), (7, "other words", None, None, 6), (3, "otherwords", None, None, 7)]
    docs = stored(spark.createDataFrame(given, kinds), "test-rows")
    once = stored(corpus_pipeline.drop_copies(spark, docs, DIR), "test-once")
    squeezed = sorted(r["text"].replace(" ", "") for r in once.collect())
    assert squeezed == sorted({t.replace(" ", "") for _, t, *_ in given})
    assert corpus_pipeline.drop_near_copies(spark, once, DIR).where("doc_id IS NULL").count() == 1
    both = [(None, long, None, None, 1), (5, near, None, None, 2), (9, long, None, None, 3)]
    left = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(both, kinds), DIR).collect()
    assert [r["doc_id"] for r in left] == [5]


def test_the_classifier_decides_who_stays(spark, runs):
    """The first stage keeps the rows whose cost, counted here from the classifier's own scores, lies within its thresholds, and those without text."""
    from tidemark.llm import quality

    _, before, after = runs[0]
    judged = quality.classify(before, queries.table(spark, DIR, "labels"), [F.col("doc_id")]).collect()
    want = sorted(r.doc_id for r in judged if r.perplexity is None or r.low <= r.perplexity <= r.high)
    assert sorted(r.doc_id for r in after.select("doc_id").collect()) == want and len(want) < len(judged)


def test_the_mix_draws_what_its_plan_takes(spark, runs):
    """Words of each document in the fourth stage's rows, against the plan by SQL: whole epochs, and a part at the cut."""
    import duckdb
    import pandas as pd

    from tidemark.llm.oracles import ORACLE_SQL

    _, before, after = runs[3]
    con = duckdb.connect()
    con.register("given", pd.DataFrame([(r.doc_id, r.text, r.source) for r in before.collect()], columns=["doc_id", "text", "source"]).astype(object))
    con.execute("CREATE TABLE documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(text AS VARCHAR) AS text, CAST(source AS VARCHAR) AS source FROM given")
    plan = {d: (size, taken) for d, size, taken in con.execute(f"SELECT doc_id, size, taken FROM ({ORACLE_SQL['op6_source_mix']})").fetchall() if taken}
    drawn, texts = {}, {r.doc_id: (r.text or "").split() for r in before.collect()}
    for r in after.collect():
        drawn.setdefault(r.doc_id, []).append(r.text.split())
    assert drawn.keys() == plan.keys()
    for key, copies in drawn.items():
        size, taken = plan[key]
        assert sum(map(len, copies)) == taken and all(c == texts[key][: len(c)] for c in copies)
        assert sorted(map(len, copies), reverse=True) == [size] * (taken // size) + ([taken % size] if taken % size else [])
