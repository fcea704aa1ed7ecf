import itertools
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tokenizers import Tokenizer, models, pre_tokenizers

from tidemark.llm import packing, token_store, tokens
from tidemark.llm.tokens import PieceEncoder

public_tokenizers = pytest.importorskip("public_tokenizers")
FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
ENCODERS = {f: PieceEncoder(public_tokenizers.path(f), entries=50) for f in FILES}
PLAIN = {f: Tokenizer.from_file(public_tokenizers.path(f)) for f in FILES}
SPECIAL = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext|", " <|endoftext|> "]
TEXT = st.lists(st.sampled_from([*"aA bB'st  \n\t\r  \x1c\x85é́ßΣ.,!<|>1一😀", *SPECIAL]), max_size=60).map("".join)


def plain(file, text):
    """The ids of the library's own call, by a tokenizer that nothing else uses."""
    return PLAIN[file].encode(text or "", add_special_tokens=False).ids


def test_strings_of_added_tokens_are_those_tokens():
    assert plain(FILES[0], "<|endoftext|> is text") == [50256, 318, 2420]
    assert plain(FILES[1], "<|endoftext|> is text") == [49407, 533, 4160]
    as_text = PieceEncoder(public_tokenizers.path(FILES[0]), plain_specials=True)
    assert 50256 not in np.frombuffer(as_text.ids("<|endoftext|> is text"), "<u4")


@pytest.mark.parametrize("file", FILES)
@settings(max_examples=300, deadline=None)
@given(texts=st.lists(TEXT, max_size=4))
def test_pieces_give_the_ids_of_the_whole_text(file, texts):
    e = ENCODERS[file]
    assert [np.frombuffer(x, "<u4").tolist() for x in map(e.ids, texts)] == [plain(file, t) for t in texts]


@pytest.mark.parametrize("file", FILES)
@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.none() | TEXT, max_size=8))
def test_batches_give_the_ids_of_each_text(file, texts):
    off, ids = ENCODERS[file].batch(pa.array(texts, pa.string()), 7)
    assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)] == [[*plain(file, t), 7] for t in texts]


def test_batches_of_other_tokenizers_and_slices():
    e = PieceEncoder(public_tokenizers.path(FILES[0]))
    e.kind = ""
    off, ids = e.batch(pa.array(["x", None, "a b", "<|endoftext|> c"]).slice(1, 3), 0)
    assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)] == [[0], [*plain(FILES[0], "a b"), 0], [*plain(FILES[0], "<|endoftext|> c"), 0]]


WORDS = ["".join(w) for w in itertools.product(["a", "be", "Cer", "dö"], ["fin", "gor", "éh"], ["ist", "jo", "k", "lle"], ["", "m", "nnen", "or", "pé"])]


class Counted:
    """An object of the library whose methods' calls are noted."""

    def __init__(self, held, calls):
        self.held, self.calls = held, calls

    def __getattr__(self, name):
        self.calls.append(name)
        return getattr(self.held, name)


def batches(e, *columns):
    """The ids of each text of some columns in turn, with 7 behind them."""
    found = [e.batch(pa.array(texts, pa.string()), 7) for texts in columns]
    return [ids[a:b].tolist() for off, ids in found for a, b in zip(off[:-1], off[1:], strict=True)]


def test_new_runs_go_to_the_library_together():
    e, calls = PieceEncoder(public_tokenizers.path(FILES[0])), []
    for name, held in list(vars(e).items()):
        if type(held).__module__.startswith("tokenizers"):
            setattr(e, name, Counted(held, calls))
    columns = [" ".join(WORDS), None, "".join(f"{w}{i}, " for i, w in enumerate(WORDS)) + "."], [" ".join(reversed(WORDS))]
    assert batches(e, *columns) == [[*plain(FILES[0], t), 7] for t in sum(columns, [])]
    assert 0 < len(calls) < 5  # not one for each of the hundreds of runs


@pytest.mark.parametrize("clash", [True, False])
def test_pieces_of_one_hash_and_long_ones_are_told_apart(monkeypatch, clash):
    monkeypatch.setattr(tokens, "CHUNK", 8)
    if clash:
        monkeypatch.setattr(tokens, "range_hash", lambda prefix, start, end: np.zeros(len(start), np.uint64))
    e = PieceEncoder(public_tokenizers.path(FILES[0]), entries=200)
    columns = WORDS[:90], [" ".join(WORDS), "information", "informations", "information"], ["x" * 20 + "a", "x" * 20 + "b", "x" * 21]
    assert batches(e, *columns, *columns) == [[*plain(FILES[0], t), 7] for t in 2 * sum(columns, [])]


@pytest.mark.parametrize(("more", "merges", "options"), [(["Āa"], [("Ā", "a")], {}), (["abc"], [], {"ignore_merges": True}), (["ab", "##b"], [("a", "##b")], {"continuing_subword_prefix": "##"})])
def test_runs_are_not_joined_for_models_that_would_mind(tmp_path, more, merges, options):
    signs = [*pre_tokenizers.ByteLevel.alphabet(), *more]
    library = Tokenizer(models.BPE(vocab={t: i for i, t in enumerate(signs)}, merges=merges, **options))
    library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    library.save(f"{tmp_path}/t.json")
    e, texts = PieceEncoder(f"{tmp_path}/t.json"), ["abc a ab cab", "a\0a aa", "abc"]
    assert e.kind == "bytes" and batches(e, texts) == [[*library.encode(t).ids, 7] for t in texts]


ROWS = [(3, "b b the cat", "x"), (1, None, None), (2, "", "y"), (None, "no id", "z"), (5, "word " * 3000, "x"), (5, "word " * 3000, "x"), (9, "<|endoftext|> is text", "x")]


def test_token_store_round_trip(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, shard string")
    path = public_tokenizers.path(FILES[0])
    token_store.write_tokens(docs, f"{tmp_path}/t", path, end_id=0)
    got = sorted(token_store.token_index(spark, f"{tmp_path}/t").collect(), key=lambda r: r.start)
    want, start = [], 0
    for key, text, _ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*plain(FILES[0], text), 0], "<u4")
        want.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == want
    one = token_store.read_tokens(spark, f"{tmp_path}/t").where("doc_id = 3")
    assert one.count() == 1 and "EqualTo(doc_id,3)" in one._jdf.queryExecution().toString()


def scanned(df):
    """Rows that the scan of df hands on, by its own count, after running it."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    while plan.children().size():
        plan = plan.children().head()
    return plan.metrics().apply("numOutputRows").value()


def test_statistics_and_bloom_filters_skip_stripes(spark, tmp_path):
    docs = spark.createDataFrame([(2 * i, f"text {i}") for i in range(900)], "doc_id long, text string")
    token_store.write_tokens(docs, f"{tmp_path}/t", public_tokenizers.path(FILES[0]), shards=3)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        ask = lambda condition: scanned(token_store.read_tokens(spark, f"{tmp_path}/t").where(condition).select("doc_id", "row"))
        assert ask("doc_id >= 0") == 900
        assert 0 < ask("doc_id = 4") < 500  # the other files' ranges exclude it
        assert [ask(f"doc_id = {i}") for i in (101, 777, 1203)].count(0) >= 2  # odd ids lie in a file's range, but not in its Bloom filter
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("rows", [ROWS, []])
def test_packing_covers_every_id_once(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, tier string")
    got = packing.pack_documents(docs, public_tokenizers.path(FILES[1])).collect()
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == np.cumsum([0, *(r.length for r in parts)])[:-1].tolist()
        total = sum(r.length for r in parts)
        assert total <= 2048 and total & (total - 1) == 0
    for key, text in {(r[0], r[1]) for r in rows}:
        ids = np.array([*plain(FILES[1], text), 1], "<u4")
        times = sum(1 for r in rows if r[:2] == (key, text))
        pieces = sorted((r.start, r.length, r.ids_crc32) for r in got if r.doc_id == key and r.doc_tokens == len(ids))
        assert sum(p[1] for p in pieces) == times * len(ids)
        assert all(zlib.crc32(ids[a : a + n].tobytes()) == c for a, n, c in pieces)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=40), st.integers(1, 8))
def test_steps_are_even_in_sequences_and_cost(costs, groups):
    of = packing.balanced(costs, groups)
    n = [of.count(g) for g in range(groups)]
    assert len(of) == len(costs) and max(n) - min(n) <= 1
    spent = [sum(c for c, g in zip(costs, of, strict=True) if g == k) for k in range(groups)]
    assert max(spent) - min(spent) <= 2 * max(costs)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 5000), max_size=40))
def test_pack_conserves_tokens(lengths):
    parts = [(n, i, 0) for i, n in enumerate(lengths)]
    full, left = packing.pack(parts)
    assert all(sum(p[0] for p in s) == tier for tier, s in full)
    assert sum(p[0] for p in left) < 2048
    tail = packing.last(left)
    covered = [[] for _ in lengths]
    for _, s in [*full, *tail]:
        for n, doc, start in s:
            covered[doc].append((start, n))
    for n, spans in zip(lengths, covered, strict=True):
        spans.sort()
        assert sum(x[1] for x in spans) == n and all(a[0] + a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_known_pieces_of_words_stay_small():
    e = PieceEncoder(public_tokenizers.path(FILES[1]))
    text = " ".join(f"{i}" for i in range(1_000_000, 1_380_000))
    tracemalloc.start()
    assert len(e.ids(text[:80])) == 4 * len(plain(FILES[1], text[:80]))
    for begin in range(0, len(text), 80_000):
        e.ids(text[begin : begin + 80_000])
    now, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert now < 45e6
