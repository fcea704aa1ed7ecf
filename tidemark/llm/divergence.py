"""Source divergence audit: how far sources of a language are from each other, and by which terms.

Tasks count the terms of their texts, Spark adds them up by (language, source, term) and then
gathers each term's postings, at most one for a source. A language keeps the terms that are in
``least`` of its documents or more; a term's share in a group is p = 1 + floor(10^9 (count + 1) / (N + V)),
and two shares differ by floor((p - q)^2 / q).

Heavy-light split: a term in more than ``LIGHT`` groups goes into dense tiles, matrices of groups by terms
that numpy compares row against row. All other terms have the same share in almost every group,
that of a count of 0; each pair of groups gets that difference for every light term at once, and postings correct it:
single ones where one group has the term, pairs of postings of a term where both have. Both
parts are whole numbers, added up by Spark. A tile is dealt by a hash of the term and holds a bounded
number of cells, so no task grows with a hot language or source.

Defined cases: null text, language and source are ''; a group without terms is a group all the same; a language
without kept terms has pairs of value 0 and no term rows; repeated rows count each; an empty table
gives an empty result; other columns of the input play no part, whatever their names. A task's memory grows
with the longest text and with the sources of one language (the result holds their square). Shares are exact
for groups of up to 9.2 * 10^15 terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .terms import NOT_LETTER, coded
from .textops import slices
from .workspace import small, small_batches, stored

#: Groups beyond which a term is heavy.
LIGHT = 8
#: Cells of a dense tile, and postings of a tile of light terms, about.
CELLS, POSTINGS = 1 << 20, 1 << 18
#: Bytes of text that a task counts at once, about.
SLICE = 4 << 20
#: Ranks of terms that a group reports.
TERMS = 200

_COUNTS = "lang string, source string, term string, count long, df long"
_SUMS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each (lang, source, term) of a slice; a row without a term says that a group is there."""
    for part in slices(batches, "text", SLICE):
        dictionary, row, term, count = coded(part.column("text"), NOT_LETTER)
        langs, sources = (part.column(c).dictionary_encode() for c in ("lang", "source"))
        group = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy(zero_copy_only=False)
        n = max(1, len(dictionary))
        key, at = np.unique(group[row] * n + term, return_inverse=True)
        total, df = np.bincount(at, count, len(key)).astype(np.int64), np.bincount(at, minlength=len(key))
        there = np.unique(group)
        all_ = np.concatenate([key // n, there])
        zeros = np.zeros(len(there), np.int64)
        named = pa.array(np.concatenate([key % n, zeros]), mask=np.arange(len(all_)) >= len(key))
        yield pa.RecordBatch.from_arrays(
            [langs.dictionary.take(pa.array(all_ // len(sources.dictionary))), sources.dictionary.take(pa.array(all_ % len(sources.dictionary))), dictionary.take(named).cast(pa.string()), pa.array(np.concatenate([total, zeros])), pa.array(np.concatenate([df, zeros]))],
            ["lang", "source", "term", "count", "df"],
        )


def postings(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = 3) -> DataFrame:
    """lang, term, postings (array of source and count): kept terms, and for each lang a row of term null that lists all its sources."""
    small_batches(docs.sparkSession)
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(empty(text_col).alias("text"), empty(lang_col).alias("lang"), empty(source_col).alias("source"))
    counts = rows.mapInArrow(_count, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("df").alias("df"))
    by_term = counts.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.collect_list(F.struct("source", "count")).alias("postings"))
    return by_term.where(F.col("term").isNull() | (F.col("df") >= least)).select("lang", "term", "postings")


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(count: Column, total: Column) -> Column:
    """1 + floor(10^9 (count + 1) / total), three digits at a time, so that nothing overflows."""
    out, rest = F.lit(0).cast("long"), count + 1
    for _ in range(3):
        out, rest = out * 1000 + _div(rest * 1000, total), (rest * 1000) % total
    return out + 1


def differ(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``share`` for arrays."""
    out, rest = np.zeros(np.broadcast(count, total).shape, np.int64), count + 1
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return out + 1


def differences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def dense(source: np.ndarray, term: np.ndarray, count: np.ndarray, terms: int, total: np.ndarray) -> np.ndarray:
    """Sums of differences of each group (row) from each (column) over the terms of a heavy tile."""
    table = np.repeat(shares(np.zeros(len(total), np.int64), total)[:, None], terms, 1)
    table[source, term] = shares(count, total[source])
    return np.array([differences(row, table).sum(1) for row in table], np.int64).reshape(len(total), len(total))


def sparse(source: np.ndarray, term: np.ndarray, count: np.ndarray, terms: int, total: np.ndarray) -> np.ndarray:
    """The same over light terms: every group's share of a missing term, corrected by single postings and by pairs of postings of a term."""
    n = len(total)
    base = shares(np.zeros(n, np.int64), total)
    common = differences(base[:, None], base)
    out = common * terms
    # Postings of one group with one count are corrected at once.
    single, times = np.unique(np.stack([source, count]), axis=1, return_counts=True)
    step = max(1, CELLS // max(1, n))
    for i in range(0, single.shape[1], step):
        s, p, m = single[0, i : i + step], shares(single[1, i : i + step], total[single[0, i : i + step]]), times[i : i + step, None]
        np.add.at(out, s, m * (differences(p[:, None], base) - common[s]))
        np.add.at(out.T, s, m * (differences(base, p[:, None]) - common.T[s]))
    p = shares(count, total[source])
    for d in range(1, LIGHT):
        a = np.flatnonzero(term[d:] == term[:-d]) if d < len(term) else np.zeros(0, int)
        if not len(a):
            break
        for x, y in ((a, a + d), (a + d, a)):
            g, h = source[x], source[y]
            both = differences(p[x], p[y]) - differences(p[x], base[h]) - differences(base[g], p[y]) + common[g, h]
            np.add.at(out, (g, h), both)
    np.fill_diagonal(out, 0)
    return out


def _tile(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """Differences of all pairs of sources over the terms of a tile. left: postings; right: source, n, v."""
    if not left.num_rows or not right.num_rows:
        return _SUMS.empty_table()
    lists = left.column("postings").combine_chunks()
    flat, lengths = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False)
    sources = right.column("source").combine_chunks()
    total = right.column("n").to_numpy() + right.column("v").to_numpy()
    source = pc.index_in(flat.field("source"), value_set=sources).to_numpy(zero_copy_only=False).astype(np.int64)
    count, term = flat.field("count").to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lengths)), lengths)
    sums = (dense if key[1].as_py() else sparse)(source, term, count, len(lengths), total)
    g, h = np.nonzero(~np.eye(len(total), dtype=bool))
    return pa.Table.from_arrays([pa.array([key[0].as_py()] * len(g), pa.string()), sources.take(pa.array(g)), sources.take(pa.array(h)), pa.array(sums[g, h])], schema=_SUMS)


def pair_sums(kept: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, source, item (another source), value: sums over all kept terms, of tiles of heavy and of light terms."""
    heavy = F.size("postings") > LIGHT
    held = kept.where("term IS NOT NULL").withColumn("heavy", heavy)
    sizes = held.groupBy("lang", "heavy").agg(F.count("*").alias("terms"), F.sum(F.size("postings")).alias("postings"))
    groups = totals.groupBy("lang").agg(F.count("*").alias("groups"))
    cells = F.when(F.col("heavy"), F.col("terms") * F.col("groups") / CELLS).otherwise(F.col("postings") / POSTINGS)
    tiles = stored(sizes.join(groups, "lang").select("lang", "heavy", F.ceil(cells).cast("int").alias("tiles")), "divergence-tiles")
    dealt = held.join(small(tiles), ["lang", "heavy"]).select("lang", "heavy", F.pmod(F.xxhash64("term"), F.col("tiles")).cast("int").alias("tile"), "postings")
    asked = tiles.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).join(totals, "lang").select("lang", "heavy", "tile", "source", "n", "v")
    key = ["lang", "heavy", "tile"]
    parts = dealt.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(_tile, "lang string, source string, item string, value long")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = 3, ranks: int = TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: every other source of the language (part pair) and the terms that a
    source has more of than its language (part term, to the given rank), most different first."""
    kept = stored(postings(docs, text_col, lang_col, source_col, least), "divergence-postings")
    each = kept.select("lang", F.explode("postings").alias("p")).groupBy("lang", F.col("p.source").alias("source")).agg(F.sum("p.count").alias("n"))
    words = kept.groupBy("lang").agg(F.count("term").alias("v"))
    totals = stored(each.join(words, "lang"), "divergence-totals")
    langs = totals.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.first("v").alias("lang_v"))
    named = totals.select("lang", "source")
    pairs = named.join(named.withColumnRenamed("source", "item"), "lang").where("source <> item").join(pair_sums(kept, totals), ["lang", "source", "item"], "left")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value")).withColumn("rank", F.row_number().over(order))

    all_ = F.aggregate("postings", F.lit(0).cast("long"), lambda a, x: a + x["count"])
    terms = kept.where("term IS NOT NULL").select("lang", "term", "postings", all_.alias("lang_count"))
    terms = terms.join(small(stored(langs, "divergence-langs")), "lang").select("lang", "term", share(F.col("lang_count"), F.col("lang_n") + F.col("lang_v")).alias("q"), F.explode("postings").alias("x"))
    terms = terms.select("lang", F.col("x.source").alias("source"), "term", "q", F.col("x.count").alias("count")).join(small(totals), ["lang", "source"])
    terms = terms.withColumn("p", share(F.col("count"), F.col("n") + F.col("v"))).where("count > 0 AND p > q")
    ranked = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), differ(F.col("p"), F.col("q")).alias("value")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks)
    return pairs.unionByName(ranked)
