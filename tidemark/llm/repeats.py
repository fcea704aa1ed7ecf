"""Removal of byte strings that occurred earlier in the corpus, by longest previous factors.

A byte goes if the longest previous factor at some start that covers it has ``LENGTH`` bytes or
more: a string of LENGTH bytes over it also starts earlier (by document id, then offset).

1. Texts that equal an earlier text as a whole are settled by their digest.
2. Every start is filed under the least hash of the short strings inside its LENGTH bytes, so
   equal strings are filed alike. Starts whose file holds nothing else occur once and are
   left; this first look moves one narrow row for about every 35 bytes.
3. Of the other starts, those whose first LENGTH bytes have the fingerprint of another's (without one,
   no factor is long enough) go into suffix order, by these bytes (all that can decide), then position. Previous and next smaller positions in that order, with the least common prefix on
   the way there, give the longest previous factor of every start, up to LENGTH (``factors``).
   Each task does so with its own texts first, and remembers strings that repeat, so that a
   passage of countless documents reaches the shuffle once a task; then files meet in groups of
   bounded size, which do it again with what tasks have sent.
4. Starts of long factors become spans, and spans are cut from the texts they belong to.

Defined cases: null text is empty; texts below LENGTH bytes lose nothing; null ids count as
larger than all others; one id with several texts is ordered by their digests; repeated rows
are copies of the first; an empty table gives an empty result; no other column is read. A
slice holds one text at least, so memory grows with the longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import column, range_hash, rolled, slices
from .workspace import BROADCAST_ROWS, discard, small_batches, stored

LENGTH, SEED = 100, 32
#: Short strings inside a string.
WIDTH = LENGTH - SEED + 1
#: Files that one group of step 3 holds, about.
FILES = 20_000
#: Array elements that a broadcast of marks or spans may hold.
MARKS = 4_000_000
_U = np.uint64


def _slide(x: np.ndarray, pick) -> np.ndarray:
    """pick (minimum or maximum) over each WIDTH neighbours of x."""
    have = 1
    while have < WIDTH:
        step = min(have, WIDTH - have)
        m = max(0, len(x) - step)
        x = pick(x[:m], x[len(x) - m :]) if step <= len(x) else x[:0]
        have += step
    return x


def _starts(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Prefix sums, hashes of all short strings, and of all starts of whole strings: position, row, file."""
    prefix = rolled(data)
    n = max(0, len(data) - SEED + 1)
    seeds = range_hash(prefix, slice(n), slice(SEED, SEED + n))
    least = _slide(seeds, np.minimum)
    count = np.maximum(0, np.diff(off) - LENGTH + 1)
    row = np.repeat(np.arange(len(count)), count)
    first = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(first[-1])
    at += np.repeat(off[:-1] - first[:-1], count)
    return prefix, seeds, at, row, least[at]


def _runs(*same: np.ndarray) -> np.ndarray:
    """Where a run begins: any of the arrays differs from its predecessor."""
    out = np.ones(len(same[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([a[1:] != a[:-1] for a in same])
    return out


def _filed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A row for each place whose short string files a start; of one that goes on repeating, two."""
    data, off = column(batch.column("text"))
    _, seeds, at, _, file = _starts(data, off)
    if not len(at):
        return pa.record_batch([pa.array([], pa.int64())] * 2, ["file", "doc"])
    of_start = np.zeros(len(seeds) + WIDTH - 1, _U)
    of_start[at + WIDTH - 1] = file
    place = np.flatnonzero((_slide(of_start, np.maximum) == seeds) & (seeds > 0))
    doc, value = np.searchsorted(off, place, "right") - 1, seeds[place]
    again = ~_runs(value, doc)
    again[1:] &= again[:-1].copy()
    keep = ~again
    ids = batch.column("doc").to_numpy(zero_copy_only=False)
    return pa.record_batch([pa.array(value[keep].view(np.int64)), pa.array(ids[doc[keep]])], ["file", "doc"])


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        yield _filed(batch)  # whose arrays are let go before the next slice's are made


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number that sorts as they do."""
    out = np.zeros(max(0, len(data) - 7), _U)
    for j in range(8):
        out <<= _U(8)
        out |= data[j : j + len(out)]
    return out


#: Where the words of a string begin; the last one overlaps the one before.
_PLACES = [*range(0, LENGTH - 8, 8), LENGTH - 8]


def _lexical(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """An order of the strings at, all different: word by word, each looking at what is still tied."""
    order = np.argsort(words[at], kind="stable")
    tied = ~_runs(words[at[order]])
    for p in _PLACES[1:]:
        inside = tied.copy()
        inside[:-1] |= tied[1:]
        part = np.flatnonzero(inside)
        if not len(part):
            break
        group = np.cumsum(~tied[part])
        key = words[at[order[part]] + p]
        by = np.lexsort((key, group))
        order[part] = order[part[by]]
        tied[part] = ~_runs(group[by], key[by])
    return order


def _common(words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the strings at a and b, up to LENGTH."""
    out, alive = np.full(len(a), LENGTH, np.int32), np.arange(len(a))
    for p in _PLACES:
        x = words[a[alive] + p] ^ words[b[alive] + p]
        done = x != 0
        same = sum((x[done] < _U(1 << (8 * i))).astype(np.int32) for i in range(1, 8))
        out[alive[done]] = p + same
        alive = alive[~done]
    return out


def _smaller(position: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For each place of the suffix order, the common prefix with the nearest place before it of a smaller position; 0 if there is none.

    common: prefix shared with the place before. All places jump at once to where the larger one before them has got.
    """
    before, shared = np.arange(len(position)) - 1, common.copy()
    active = np.arange(len(position))
    while len(active):
        j = before[active]
        active = active[(j >= 0) & (position[j] >= position[active])]
        j = before[active]
        shared[active] = np.minimum(shared[active], shared[j])
        before[active] = before[j]
    shared[before < 0] = 0
    return shared


def factors(data: np.ndarray, at: np.ndarray, position: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """The longest previous factor, up to LENGTH, of the starts at, among each other.

    position: their places in the corpus' order (equal ones don't count for each other); mark: fingerprints of their first LENGTH bytes.
    """
    if not len(at):
        return np.zeros(0, np.int32)
    index = np.lexsort((position, mark))
    new = _runs(mark[index])
    words, more = _words(data), np.flatnonzero(~new)
    mine, head = at[index[more]], at[index[np.maximum.accumulate(np.where(new, np.arange(len(index)), 0))[more]]]
    if any((words[mine + p] != words[head + p]).any() for p in _PLACES):  # different strings of one fingerprint: all strings get new ones, by their bytes
        view = np.lib.stride_tricks.sliding_window_view(data, LENGTH)
        return factors(data, at, position, np.unique(view[at], axis=0, return_inverse=True)[1].ravel().astype(_U))
    first = index[new]
    order = _lexical(words, at[first])
    place = np.empty(len(first), np.int64)
    place[order] = np.arange(len(first))
    run = np.cumsum(new) - 1
    by = np.argsort(place[run], kind="stable")
    suffixes, begins = index[by], new[by]
    common = np.full(len(suffixes), LENGTH, np.int32)
    heads = at[first[order]]
    common[np.flatnonzero(begins)] = np.concatenate([[0], _common(words, heads[:-1], heads[1:])])
    rank = position[suffixes]
    longest = np.maximum(_smaller(rank, common), _smaller(rank[::-1], np.concatenate([[0], common[:0:-1]]).astype(np.int32))[::-1])
    out = np.empty(len(at), np.int32)
    out[suffixes] = longest
    return out


def _settled(data: np.ndarray, at: np.ndarray, position: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which starts have a factor of LENGTH bytes, and which others have a string that such a one repeats."""
    order = np.argsort(mark)
    ends = np.flatnonzero(_runs(mark[order]))
    several = np.repeat((n := np.diff([*ends, len(order)])) > 1, n)
    some = order[several]
    gone, first = np.zeros(len(at), bool), np.zeros(len(at), bool)
    gone[some] = factors(data, at[some], position[some], mark[some]) >= LENGTH
    first[some] = ~gone[some]
    return gone, first


def _positions(key: np.ndarray, tie: np.ndarray, row: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Numbers in the order of (key, tie) of the rows, then place."""
    order = np.lexsort((tie, key))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(_runs(key[order], tie[order])) - 1
    return (rank[row] << 32) + place


class _Known:
    """Strings that repeat in a task's texts, with the least position seen: later ones need not be sent."""

    def __init__(self, most: int = 200_000) -> None:
        self.most, self.mark = most, np.zeros(0, _U)
        self.held = [np.zeros(0, np.int64) for _ in range(3)]
        self.text = np.zeros((0, LENGTH), np.uint8)

    def earlier(self, view: np.ndarray, at: np.ndarray, mark: np.ndarray, keys: tuple[np.ndarray, ...]) -> np.ndarray:
        """Which starts (keys: id, tie, place) have an equal string among those known, at a smaller position."""
        out = np.zeros(len(at), bool)
        if not len(self.mark):
            return out
        j = np.minimum(np.searchsorted(self.mark, mark), len(self.mark) - 1)
        hit = np.flatnonzero(self.mark[j] == mark)
        for begin in range(0, len(hit), 50_000):
            h = hit[begin : begin + 50_000]
            k = j[h]
            (a, b, c), (x, y, z) = (v[k] for v in self.held), (v[h] for v in keys)
            less = (a < x) | ((a == x) & ((b < y) | ((b == y) & (c < z))))
            out[h] = less & (view[at[h]] == self.text[k]).all(1)
        return out

    def add(self, view: np.ndarray, at: np.ndarray, mark: np.ndarray, keys: tuple[np.ndarray, ...]) -> None:
        mark, first = np.unique(mark, return_index=True)
        fresh = ~np.isin(mark, self.mark)
        mark, first = mark[fresh][: self.most - len(self.mark)], first[fresh][: self.most - len(self.mark)]
        by = np.argsort(both := np.concatenate([self.mark, mark]))
        self.mark = both[by]
        self.held = [np.concatenate([old, new[first]])[by] for old, new in zip(self.held, keys, strict=True)]
        self.text = np.concatenate([self.text, view[at[first]]])[by]


_KINDS = [("task", pa.int64()), ("doc", pa.int64()), ("id", pa.int64()), ("tie", pa.int64()), ("start", pa.int64()), ("count", pa.int64()), ("bytes", pa.binary())]
_SHIPPED = "task long, doc long, id long, tie long, start long, count long, bytes binary"


def _sent(batch: pa.RecordBatch, known: _Known, groups: int) -> list[pa.RecordBatch]:
    """What a slice hands on: runs of starts that are settled here, and the others with their bytes."""
    data, off = column(batch.column("text"))
    prefix, _, at, row, file = _starts(data, off)
    del _
    keys = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in ("doc", "id", "tie")}
    shared = batch.column("files").flatten().to_numpy(zero_copy_only=False).view(_U)
    begin = np.flatnonzero(_runs(file))  # neighbours mostly lie in one file
    wanted = np.repeat(np.isin(file[begin], shared), np.diff([*begin, len(file)]))
    at, row, file = at[wanted], row[wanted], file[wanted]
    if not len(at):
        return []
    place, mark = at - off[row], range_hash(prefix, at, at + LENGTH)
    del prefix, wanted
    gone, first = _settled(data, at, _positions(keys["id"], keys["tie"], row, place), mark)
    view = np.lib.stride_tricks.sliding_window_view(data, LENGTH)
    where = (keys["id"][row], keys["tie"][row], place)
    gone |= known.earlier(view, at, mark, where)
    first &= ~gone
    known.add(view, at[first], mark[first], tuple(w[first] for w in where))
    out = []
    for part, sent in ((np.flatnonzero(gone), False), (np.flatnonzero(~gone), True)):
        p, r, f = at[part], row[part], file[part]
        begin = np.flatnonzero(_runs(r, p - np.arange(len(p)), f) if sent else _runs(r, p - np.arange(len(p))))
        n = np.diff([*begin, len(p)])
        b, r = p[begin], r[begin]
        task = (f[begin] % _U(groups)).astype(np.int64) if sent else np.full(len(b), -1)
        held = [data[x : x + c + LENGTH - 1].tobytes() for x, c in zip(b, n, strict=True)] if sent else [None] * len(b)
        values = [task, keys["doc"][r], keys["id"][r], keys["tie"][r], b - off[r], n, held]
        out.append(pa.record_batch([pa.array(v, k) for v, (_, k) in zip(values, _KINDS, strict=True)], [k for k, _ in _KINDS]))
    return out


def _ship(groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known()
        for batch in slices(batches, "text"):
            yield from _sent(batch, known, groups)

    return run


def _meet(table: pa.Table) -> pa.Table:
    """One group of files: runs of starts that an earlier position makes repeats."""
    table = table.combine_chunks()
    held = table.column("bytes").combine_chunks()
    data = np.frombuffer(b"".join(held.to_pylist()), np.uint8)
    n = table.column("count").to_numpy()
    base = np.concatenate([[0], np.cumsum(n + LENGTH - 1)])[:-1]
    row = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = base[row] + step
    value = {k: table.column(k).to_numpy() for k in ("doc", "id", "tie", "start")}
    place = value["start"][row] + step
    gone, _ = _settled(data, at, _positions(value["id"], value["tie"], row, place), range_hash(rolled(data), at, at + LENGTH))
    r, p = row[gone], place[gone]
    begin = np.flatnonzero(_runs(r, p - np.arange(len(p))))
    return pa.table({"doc": value["doc"][r[begin]], "start": p[begin], "count": np.diff([*begin, len(p)]).astype(np.int64)})


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc, text, spans in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            data, end, kept, removed, count = (text or "").encode("utf-8", "surrogatepass"), 0, hashlib.sha256(), 0, 0
            last = 0
            for s in sorted((s["start"], s["start"] + s["count"] + LENGTH - 1) for s in spans):
                if s[0] > end or not count:
                    kept.update(data[last : s[0]])
                    count += 1
                    removed += s[1] - s[0]
                    last = end = s[1]
                elif s[1] > end:
                    removed += s[1] - end
                    last = end = s[1]
            kept.update(data[last:])
            out.append((doc, removed, count, kept.hexdigest()))
        columns = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, [pa.int64(), pa.int64(), pa.int64(), pa.string()], strict=True)], ["doc", "n_removed", "n_spans", "kept_sha256"])


def _near(df: DataFrame, lists: str) -> DataFrame:
    """df with a broadcast hint if it is small in rows and list elements."""
    size = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size(lists)), F.lit(0)).alias("m")).first()
    return F.broadcast(df) if size["n"] <= BROADCAST_ROWS and size["m"] <= MARKS else df


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    sha = F.sha2(text.cast("binary"), 256)
    named = docs.select(F.col(id_col).cast("long").alias("real"), text.alias("text"), sha.alias("sha"))
    named = named.select("real", F.coalesce("real", F.lit((1 << 63) - 1)).alias("id"), "text", "sha", F.conv(F.substring("sha", 1, 15), 16, 10).cast("long").alias("tie"))
    draw = 0
    while True:  # a document is named by 64 bits of its id and digest; should two get one name, all names are drawn anew
        rows = named.withColumn("doc", F.xxhash64(F.lit(draw), "real", "sha"))
        own = stored(rows.select("real", "id", "sha", "doc", F.octet_length("text").cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("row_no")), "repeat-texts")
        who = F.struct("real", "sha")
        if own.groupBy("doc").agg((F.min(who) < F.max(who)).alias("two")).where("two").isEmpty():
            break
        discard(own)
        draw += 1
    firsts = own.groupBy("sha").agg(F.min(F.struct("id", "row_no", "doc")).alias("first"))
    judged = stored(own.join(firsts, "sha").select("real", "sha", "doc", "n_bytes", F.col("first.row_no").alias("keep"), "row_no", F.col("first.doc").alias("first_doc")), "repeat-firsts")
    copies = stored(judged.where("doc <> first_doc").select("doc").distinct(), "repeat-copies")
    copies = F.broadcast(copies) if copies.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else copies
    texts = rows.where(F.octet_length("text") >= LENGTH).join(copies, "doc", "left_anti").select("doc", "id", "tie", "text")

    # Rows of one id and one text have one name: one of them stands for all, and a task hands on one at most.
    repeated = stored(own.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").select("doc"), "repeat-rows")
    if not repeated.isEmpty():
        again = F.broadcast(repeated) if repeated.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else repeated
        one = texts.join(again, "doc", "left_semi").groupBy("doc").agg(*[F.any_value(c).alias(c) for c in ("id", "tie", "text")])
        texts = stored(texts.join(again, "doc", "left_anti").unionByName(one), "repeat-single")

    files = texts.select("doc", "text").mapInArrow(_files, "file long, doc long")
    shared = files.groupBy("file").agg(F.count("*").alias("n")).where("n > 1").select("file")
    marked = stored(files.join(shared, "file").groupBy("doc").agg(F.collect_set("file").alias("files")), "repeat-marks")
    total = marked.agg(F.sum(F.size("files"))).first()[0] or 0
    shipped = stored(texts.join(_near(marked, "files"), "doc").mapInArrow(_ship(max(8, -(-total // FILES))), _SHIPPED), "repeat-starts")
    met = shipped.where("task >= 0").groupBy("task").applyInArrow(_meet, "doc long, start long, count long")
    gone = shipped.where("task < 0").select("doc", "start", "count").unionByName(met)
    spans = stored(gone.groupBy("doc").agg(F.collect_list(F.struct("start", "count")).alias("spans")), "repeat-spans")
    cut = texts.select("doc", "text").join(_near(spans, "spans"), "doc").mapInArrow(_cut, "doc long, n_removed long, n_spans long, kept_sha256 string").dropDuplicates(["doc"])

    copy = F.col("row_no") != F.col("keep")
    whole = copy & (F.col("n_bytes") >= LENGTH)
    out = judged.join(stored(cut, "repeat-cuts"), "doc", "left")
    pick = lambda c, all_, none: F.when(whole, all_).when(copy, none).otherwise(F.coalesce(c, none))
    return out.select(
        F.col("real").alias("id"),
        "n_bytes",
        pick("n_removed", F.col("n_bytes"), F.lit(0)).cast("long").alias("n_removed"),
        pick("n_spans", F.lit(1), F.lit(0)).cast("long").alias("n_spans"),
        pick("kept_sha256", F.lit(hashlib.sha256(b"").hexdigest()), F.col("sha")).alias("kept_sha256"),
    )
