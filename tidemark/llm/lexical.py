"""Ranked lexical search for a stated set of items, over a clustered index that stops exactly.

1. One pass over the texts: each document's length and its occurrences of the items' terms, a narrow table.
   Numbers of documents, terms and documents by term come from it.
2. Recursive graph bisection (``bisection``): a tree is fitted on a sample of about ``SAMPLE`` documents, every
   document is routed down it, and leaves are dealt into shards of about ``SHARD`` documents, a leaf that copies
   fill as well. Each shard goes on with the bisection down to clusters of ``CLUSTER``.
   The sample decides where documents lie, never what is found.
3. A shard is one row: its documents in that order, its postings by term with their impacts, and for each term and
   cluster the greatest impact, which bounds what any document there can score for an item.
4. Search: the shards with the greatest bounds give each item a first threshold, the score of its 10th document. Then every
   shard whose bound reaches it is visited, cluster by cluster from the greatest bound down, until
   the next bound is below the item's threshold. A bound that ties is visited, since ties go to the smaller doc_id.

A score is a sum of weight * impact over an item's terms, repeats included; weight is floor(1000 ln((2 N + 2) / (2 df + 1))),
impact 10^9 tf div (1000 tf + 8 m), m = 25 + 75 n N div L.

Items are taken in batches of about ``VOCABULARY`` terms, each over all documents; one item's terms are kept together.

Defined cases: a null text has no term; a document or an item without terms is never found and finds nothing;
a null doc_id ranks after all others; rows repeated under one id are documents of their own, and so are items; an empty table on
either side gives an empty result; other columns play no part, whatever their names. A task's memory grows with the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bisection
from .terms import NOT_ALNUM, coded
from .textops import slices
from .workspace import small_batches, stored

#: Documents that the tree is fitted on, of a shard, and of a cluster, about.
SAMPLE, SHARD, CLUSTER = 8192, 4096, 128
#: Depth of the tree, and terms times nodes, at most.
DEPTH, WEIGHTS = 8, 1 << 22
#: Terms of a batch of items, about.
VOCABULARY = 200_000
#: Shards that give an item its first threshold.
FIRST = 2
#: Bytes of text that a task reads at once, about.
SLICE = 4 << 20

#: Stands for a null id while documents are ranked.
NO_ID = (1 << 63) - 1

_DOCS = "id long, n long, terms array<int>, tfs array<int>"
_SHARD = "ids binary, known binary, term_at binary, impact binary, position binary, run_at binary, run_cluster binary, run_most binary, most binary"
_FOUND = "item int, id long, score long"


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item (a number), item_id, terms (texts), counts: what the items ask for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            dictionary, row, term, count = coded(part.column("text"), NOT_ALNUM)
            at = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(at), x) for x in (dictionary.take(pa.array(term)).cast(pa.string()), pa.array(count))]
            yield pa.RecordBatch.from_arrays([part.column("item_id"), *lists], ["item_id", "terms", "counts"])

    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "item_id long, terms array<string>, counts array<long>").withColumn("item", F.monotonically_increasing_id())


def documents(docs: DataFrame, vocabulary: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n (all terms), terms, tfs: occurrences of the vocabulary's terms (by their numbers) in every document that has a term."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = pa.array(held.value, pa.large_string())
        for part in slices(batches, "text", SLICE):
            dictionary, row, term, count = coded(part.column("text"), NOT_ALNUM)
            n = np.bincount(row, count, part.num_rows).astype(np.int64)
            number = pc.index_in(dictionary, value_set=asked).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32)
            number = number[term] if len(number) else np.zeros(0, np.int32)
            here = number >= 0
            at = np.searchsorted(row[here], np.arange(part.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x[here].astype(np.int32))) for x in (number, count)]
            out = pa.RecordBatch.from_arrays([part.column("id"), pa.array(n), *lists], ["id", "n", "terms", "tfs"])
            yield out.filter(pa.array(n > 0))

    known = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    return docs.select(known.alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).mapInArrow(run, _DOCS)


def _flat(frame: pd.DataFrame, *names: str) -> tuple[np.ndarray, ...]:
    """Row numbers and the values of list columns, one after another."""
    size = frame[names[0]].map(len).to_numpy(np.int64) if len(frame) else np.zeros(0, np.int64)
    return np.repeat(np.arange(len(frame)), size), *(np.concatenate([*frame[n], np.zeros(0, np.int64)]).astype(np.int64) for n in names)


def fitted(rows: DataFrame, count: int, terms: int) -> tuple[np.ndarray, np.ndarray]:
    """The tree, fitted in one task on a sample of about SAMPLE rows."""
    depth = 0
    while depth < DEPTH and (SHARD << depth) < count and (2 << depth) * terms <= WEIGHTS:
        depth += 1
    if not depth:
        return np.zeros((0, terms), np.float32), np.zeros(0)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        doc, term = _flat(frame, "terms")
        weights, bounds = bisection.fit(doc, term, len(frame), terms, depth)
        return pd.DataFrame({"node": np.arange(len(bounds)), "weights": [w.tobytes() for w in weights], "bound": bounds})

    nodes = rows.where(F.rand(7) < SAMPLE / count).select("terms", F.lit(0).alias("all")).groupBy("all").applyInPandas(run, "node int, weights binary, bound double").orderBy("node").collect()
    if not nodes:
        return np.zeros((0, terms), np.float32), np.zeros(0)
    return np.stack([np.frombuffer(r.weights, np.float32) for r in nodes]), np.array([r.bound for r in nodes])


def sharded(rows: DataFrame, tree: tuple[np.ndarray, np.ndarray], count: int) -> DataFrame:
    """rows (id, impacts ...) with leaf and part, the shard that they belong to."""
    if not len(tree[1]):
        placed = rows.withColumn("leaf", F.lit(0))
    else:
        held = rows.sparkSession.sparkContext.broadcast(tree)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in batches:
                doc, term = _flat(frame, "terms")
                yield frame.assign(leaf=bisection.route(*held.value, doc, term, len(frame)).astype(np.int32))

        placed = rows.mapInPandas(run, "id long, terms array<int>, impacts array<int>, leaf int")
    placed = stored(placed, "lexical-leaves")
    sizes = placed.groupBy("leaf").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("parts"))
    # A row a leaf, of which the tree has 2^DEPTH at most.
    return placed.join(F.broadcast(sizes), "leaf").withColumn("part", F.pmod(F.xxhash64("id", "terms", F.monotonically_increasing_id()), F.col("parts")).cast("int")).drop("parts")


def shard(frame: pd.DataFrame) -> pd.DataFrame:
    """One row: the documents in bisection order, postings by term, and runs of a term's postings in a cluster with their greatest impact."""
    doc, term, impact = _flat(frame, "terms", "impacts")
    order = bisection.order(doc, term, len(frame), CLUSTER)
    place = np.empty(len(frame), np.int64)
    place[order] = np.arange(len(frame))
    ids = frame["id"].to_numpy(np.int64)
    by = np.lexsort((place[doc], term))
    term, impact, position = term[by], impact[by], place[doc][by]
    known, term_at = np.unique(term, return_index=True)
    cluster = position // CLUSTER
    new = np.ones(len(term), bool)
    new[1:] = (term[1:] != term[:-1]) | (cluster[1:] != cluster[:-1])
    run_at = np.flatnonzero(new)
    most = np.maximum.reduceat(impact, run_at) if len(run_at) else impact[:0]
    whole = np.maximum.reduceat(impact, term_at) if len(term_at) else impact[:0]
    parts = [ids[order], known, np.append(term_at, len(term)), impact, position, np.append(run_at, len(term)), cluster[run_at], most, whole]
    return pd.DataFrame([[x.astype(np.int64 if i == 0 else np.int32).tobytes() for i, x in enumerate(parts)]], columns=[c.split()[0] for c in _SHARD.split(", ")])


class _Shard:
    def __init__(self, row) -> None:
        for i, name in enumerate(c.split()[0] for c in _SHARD.split(", ")):
            setattr(self, name, np.frombuffer(getattr(row, name), np.int64 if i == 0 else np.int32))
        self.clusters = -(-len(self.ids) // CLUSTER)
        self.runs_of = np.searchsorted(self.run_at, self.term_at)

    def terms(self, asked: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in known of the terms asked for that are here, and their weights."""
        at = np.minimum(np.searchsorted(self.known, asked), max(0, len(self.known) - 1))
        here = self.known[at] == asked if len(self.known) else np.zeros(len(asked), bool)
        return at[here], weight[here]


def _spread(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in all [start, stop), and which of them each belongs to."""
    size = stop - start
    of = np.repeat(np.arange(len(size)), size)
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + start[of], of


def visit(s: _Shard, asked: np.ndarray, weight: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores): documents of a shard among which are all that may be in the item's best k, given that k score least or more."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, weight = s.terms(asked, weight)
    if (bound := int((weight * s.most[at]).sum())) < max(1, least):
        return none
    runs, of = _spread(s.runs_of[at], s.runs_of[at + 1])
    weight = weight[of]
    bounds = np.zeros(s.clusters, np.int64)
    np.add.at(bounds, s.run_cluster[runs], weight * s.run_most[runs])
    order = np.argsort(-bounds, kind="stable")
    place = np.empty(s.clusters, np.int64)
    place[order] = np.arange(s.clusters)
    when = place[s.run_cluster[runs]]
    ids, scores = none
    done, size = 0, 1
    while done < s.clusters and (bound := int(bounds[order[done]])) >= max(1, least):
        here = (when >= done) & (when < done + size)
        postings, run = _spread(s.run_at[runs[here]], s.run_at[runs[here] + 1])
        total = np.zeros(len(s.ids), np.int64)
        np.add.at(total, s.position[postings], weight[here][run] * s.impact[postings])
        hit = np.flatnonzero(total)
        ids, scores = np.concatenate([ids, s.ids[hit]]), np.concatenate([scores, total[hit]])
        best = np.lexsort((ids, -scores))[:k]
        ids, scores = ids[best], scores[best]
        if len(scores) == k:
            least = max(least, int(scores[-1]))
        done, size = done + size, size * 4
    return ids, scores


def searched(index: DataFrame, asked: list[tuple[int, np.ndarray, np.ndarray]], k: int, least: dict[int, int], only: DataFrame | None = None) -> DataFrame:
    """item, id, score of the best k of each shard that is visited. least: thresholds; only: (shard, item), or all items everywhere."""
    held = index.sparkSession.sparkContext.broadcast((asked, least))
    some = only.groupBy("shard").agg(F.collect_list("item").alias("items")) if only is not None else None
    rows = index.join(some, "shard") if some is not None else index.withColumn("items", F.lit(None).cast("array<int>"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked, least = held.value
        by, least = {i: (t, w) for i, t, w in asked}, dict(least)
        for frame in frames:
            for row in frame.itertuples():
                s, out = _Shard(row), []
                for i in by if row.items is None else row.items:
                    ids, scores = visit(s, *by[i], k, least.get(i, 0))
                    if len(scores) == k:
                        least[i] = max(least.get(i, 0), int(scores[-1]))
                    out.append(pd.DataFrame({"item": np.full(len(ids), i, np.int32), "id": ids, "score": scores}))
                yield pd.concat(out) if out else pd.DataFrame({"item": [], "id": [], "score": []}, dtype="int64")

    return rows.mapInPandas(run, _FOUND)


def best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def promising(index: DataFrame, asked: list[tuple[int, np.ndarray, np.ndarray]]) -> DataFrame:
    """(shard, item): for each item the FIRST shards by bound."""
    held = index.sparkSession.sparkContext.broadcast(asked)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples():
                known, most = np.frombuffer(row.known, np.int32), np.frombuffer(row.most, np.int32)
                for i, terms, weight in held.value:
                    at = np.minimum(np.searchsorted(known, terms), max(0, len(known) - 1))
                    here = known[at] == terms if len(known) else np.zeros(len(terms), bool)
                    out.append((row.shard, i, int((weight[here] * most[at[here]]).sum())))
            yield pd.DataFrame(out, columns=["shard", "item", "bound"])

    bounds = index.select("shard", "known", "most").mapInPandas(run, "shard long, item int, bound long").where("bound > 0")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "shard"))
    return bounds.withColumn("rank", rank).where(F.col("rank") <= FIRST).select("shard", "item")


def _batch(docs: DataFrame, items: list, k: int, id_col: str, text_col: str) -> DataFrame:
    """item, id, score, rank for a batch of items (item, terms, counts)."""
    spark = docs.sparkSession
    vocabulary = sorted({t for r in items for t in r.terms})
    number = {t: i for i, t in enumerate(vocabulary)}
    rows = stored(documents(docs, vocabulary, id_col, text_col), "lexical-documents")
    n_docs, length = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    df = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).select("term", weight.alias("weight"))
    weights = np.zeros(len(vocabulary), np.int64)
    for r in df.collect():  # a row for each term of the batch at most
        weights[r.term] = r.weight
    asked = []
    for i, r in enumerate(items):
        terms = np.array([number[t] for t in r.terms], np.int32)
        by = np.argsort(terms)
        asked.append((i, terms[by], weights[terms[by]] * np.array(r.counts, np.int64)[by]))
    # Beyond 64 bits, as decimals.
    m = 25 + F.call_function("div", F.col("n").cast("decimal(18,0)") * F.lit(75 * n_docs).cast("decimal(20,0)"), F.lit(length).cast("decimal(20,0)"))
    impact = F.transform("tfs", lambda tf: F.call_function("div", F.lit(10**9) * tf.cast("long"), 1000 * tf.cast("long") + 8 * F.col("m")).cast("int"))
    held = rows.where(F.size("terms") > 0).withColumn("m", m)
    tree = fitted(held, n_docs, len(vocabulary))
    dealt = sharded(held.select("id", "terms", impact.alias("impacts")), tree, n_docs)
    built = dealt.groupBy("leaf", "part").applyInPandas(shard, _SHARD)
    index = stored(built.withColumn("shard", F.monotonically_increasing_id()), "lexical-index")
    first = best(searched(index, asked, k, {}, promising(index, asked)), k)
    least = {r.item: r.score for r in first.where(F.col("rank") == k).select("item", "score").collect()}  # a row an item at most
    found = best(searched(index, asked, k, least), k)
    of = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(items)], "item int, item_id long")
    null = F.when(F.col("id") < NO_ID, F.col("id"))
    return found.join(of, "item").select("item_id", F.col("rank").cast("int").alias("rank"), null.alias("id"), "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank (from 1), id, score: the k best documents of each item with a score above 0."""
    spark = docs.sparkSession
    small_batches(spark)
    wanted = stored(item_terms(items, item_col, item_text_col).where(F.size("terms") > 0), "lexical-items")
    batches = -(-int(wanted.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]) // VOCABULARY)
    out = spark.createDataFrame([], "item_id long, rank int, id long, score long")
    for b in range(batches):
        part = wanted.where(F.pmod(F.xxhash64("item"), F.lit(batches)) == b).orderBy("item").collect()
        if part:
            out = out.unionByName(_batch(docs, part, k, id_col, text_col))
    return out
