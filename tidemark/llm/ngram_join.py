"""Jaccard join of documents on word n-grams with prefix trees, to exact components.

1. Documents with the same set of shingles form a class; from there on a class counts once.
2. Prefix filter: under one order of all shingles, by hash, two linked classes share at least
   ``least(n)`` of their first ``prefix(n)`` shingles. Classes that share fewer with all others
   together link with nothing.
3. Of the shingles that its prefix shares with others, a remaining class takes the rarest as keys, so
   many that two linked classes have a key in common. What common keys connect is a group.
4. A class goes to its group once, not to each of its keys. A group of many classes is cut into
   parts, and every two parts meet in a task of bounded size, where a prefix tree of one part's sets
   answers the other's. A group beyond ``GROUP`` classes is taken key by key instead.
5. The tasks' links, only so many as connect what all of them would, give the components.

Shingles are told apart by 64-bit hashes. A class is named by 64 bits of the digest of its set;
should two sets of different digests get one name, all names are drawn anew.

Defined cases: null text is empty; a document without words has no shingles and links with
nothing; 1 to 4 words count as one shingle; a null id never names a component unless alone;
repeated rows are members each; an empty table gives an empty result; no other column is read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import trie
from .components import components
from .textops import SMALL, column, shingles, slices
from .workspace import discard, lean, small, small_batches, stored, tidy

GRAM = 5
#: Passages of fewer shingles than this make no candidates.
FLOOR = 64
#: Sets that one prefix tree holds, about, and shingles in them.
PART, SHINGLES = 1024, 1_000_000
#: Classes of a group that is still taken as a whole.
GROUP = 50_000


def overlap(n: int) -> int:
    """Shingles that a set of n shares at least with any that it links with."""
    return (trie.PERCENT * n + 99) // 100


def extra(n: int) -> int:
    """Shared prefix shingles that prefixes are long enough for: all that a short set must share, FLOOR or more else."""
    return min(overlap(n), max(FLOOR, n // 16))


def prefix(n: int) -> int:
    return n - overlap(n) + extra(n)


def least(n: Column) -> Column:
    """Shared prefix shingles that a set of n needs; partners have 0.8 n or more."""
    m = F.ceil(n * trie.PERCENT / 100)
    return F.least(F.ceil(m * trie.PERCENT / 100), F.greatest(F.lit(FLOOR), F.floor(m / 16))).cast("int")


def _set_rows(batch: pa.RecordBatch, whole: bool, salt: bytes) -> pa.RecordBatch:
    data, off = column(batch.column("text"))
    h, first, _ = shingles(data, off, GRAM)
    sizes, names, checks, parts = [], [], [], []
    for a, b in zip(first[:-1], first[1:], strict=True):
        s = np.unique(h[a:b])
        digest = hashlib.blake2b(s.tobytes(), digest_size=16, salt=salt).digest()
        sizes.append(len(s))
        for held, part in ((names, digest[:8]), (checks, digest[8:])):
            held.append(int.from_bytes(part, "little", signed=True) if len(s) else None)
        parts.append(s if whole else s[: prefix(len(s))])
    n, name = pa.array(sizes, pa.int32()), pa.array(names, pa.int64())
    if whole:
        return pa.record_batch([n, name, pa.array([p.tobytes() for p in parts], pa.binary())], ["n", "class", "grams"])
    ends = np.cumsum([0, *map(len, parts)])
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*parts, np.zeros(0, np.uint64)]).astype(np.uint64).view(np.int64)))
    return pa.record_batch([batch.column("id"), n, name, pa.array(checks, pa.int64()), lists], ["id", "n", "class", "check", "prefix"])


def _sets(whole: bool, draw: int = 0):
    """Sets of the texts' shingles, whole or as prefixes, with their size, name and check (the rest of the digest)."""
    salt = draw.to_bytes(8, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SMALL):
            yield _set_rows(batch, whole, salt)  # whose arrays are let go before the next slice's are made

    return run


def _classes(rows: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Every row with its class, stored; the prefixes that come with them; and the draw of names."""
    draw = 0
    while True:
        found = rows.mapInArrow(_sets(False, draw), "id long, n int, class long, check long, prefix array<long>")
        own = stored(found.select("id", "n", "class", "check"), "join-classes")
        if own.where("class IS NOT NULL").groupBy("class").agg((F.min("check") < F.max("check")).alias("two")).where("two").isEmpty():
            return own.drop("check"), found, draw
        discard(own)
        draw += 1


def _linked(frame: pd.DataFrame) -> pd.DataFrame:
    """Links of the parts that meet in one task."""
    lean()
    out = []
    for (_, i, j), g in frame.groupby(["group", "i", "j"], sort=False):
        g = g.drop_duplicates(["part", "class"])
        sides = [g[g["part"] == p] for p in ((i,) if i == j else (i, j))]
        sets = [[np.frombuffer(b, np.uint64) for b in side["grams"]] for side in sides]
        name = np.concatenate([side["class"].to_numpy() for side in sides])
        out += [(name[a], name[b]) for a, b in trie.links(*sets)]
        del g, sides, sets
    lean()
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _groups(live: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(group, class) for every live class that has a key in common with another; and the tables that it reads."""
    key = F.explode(F.expr("slice(sort_array(shared), 1, greatest(1, size(shared) - least + 1))"))
    keys = stored(live.select("class", "n", key.alias("key")).select("class", "n", "key.token"), "join-keys")
    heads = keys.groupBy("token").agg(F.min("class").alias("head"), F.count("*").alias("size")).where("size > 1").select("token", "head")
    held = stored(components(keys.join(heads, "token").select(F.col("class").alias("a"), F.col("head").alias("b"))), "join-groups")
    large = held.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") > GROUP).select("component")
    whole = held.join(large, "component", "left_anti").select(F.col("component").alias("group"), F.col("node").alias("class"))
    rest = held.join(large, "component", "left_semi").select(F.col("node").alias("class"))
    return whole.unionByName(keys.join(heads, "token").join(rest, "class", "left_semi").select(F.col("token").alias("group"), "class")), [keys, held]


def _links(live: DataFrame, sets: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(a, b): links that connect the live classes as all links would; and the tables that they are read from."""
    groups, used = _groups(live)
    grouped = stored(groups.join(live.select("class", "n"), "class"), "join-members")
    for table in used:
        discard(table)
    parts = grouped.groupBy("group").agg(F.greatest(F.ceil(F.count("*") / PART), F.ceil(F.sum("n") / SHINGLES)).cast("int").alias("parts"))
    placed = grouped.join(parts, "group").withColumn("part", F.pmod(F.xxhash64("class"), "parts").cast("int"))
    met = placed.select("group", "class", "n", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    met = met.select("group", "class", "n", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    tasks = max(8, -(-(met.agg(F.sum("n")).first()[0] or 0) // SHINGLES))
    spread = met.join(sets, "class").withColumn("task", F.pmod(F.xxhash64("group", "i", "j"), F.lit(tasks)))
    return spread.groupBy("task").applyInPandas(_linked, "a long, b long"), [grouped]


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, class_id (smallest id with the same set), component_id for every row of docs."""
    small_batches(docs.sparkSession)
    tidy(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    own, found, draw = _classes(rows)
    tokens = found.where("class IS NOT NULL").select("class", F.explode("prefix").alias("token"))
    shared = tokens.groupBy("token").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.count("*").alias("df")).where("lo < hi").select("token", "df")
    live = tokens.join(shared, "token").groupBy("class").agg(F.collect_set(F.struct("df", "token")).alias("shared"))
    classes = own.where("class IS NOT NULL").groupBy("class").agg(F.min("id").alias("rep"), F.max("n").alias("n"))
    live = stored(live.join(classes, "class").withColumn("least", least(F.col("n"))).where(F.size("shared") >= F.col("least")), "join-live")
    del tokens, shared
    tidy(docs.sparkSession)

    reps = live.select(F.col("rep").alias("id")).where("id IS NOT NULL")
    wanted = rows.join(small(reps), "id", "left_semi").unionByName(rows.where("id IS NULL"))
    sets = wanted.select("text").mapInArrow(_sets(True, draw), "n int, class long, grams binary")
    sets = stored(sets.join(small(live.select("class")), "class", "left_semi").dropDuplicates(["class"]).select("class", "grams"), "join-sets")
    links, used = _links(live, sets)
    final = components(links)
    for table in (sets, live, *used):
        discard(table)

    named = own.join(final, own["class"] == final["node"], "left").select("id", "n", "class", F.coalesce("component", "class").alias("component"))
    named = stored(named, "join-members")
    first = named.where("component IS NOT NULL").groupBy("component").agg(F.min("id").alias("component_id"))
    same = classes.select("class", F.col("rep").alias("class_id"))
    out = named.join(first, "component", "left").join(same, "class", "left")
    return out.select("id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("component_id", "id").alias("component_id"))
