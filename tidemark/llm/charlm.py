"""Character n-gram models with interpolated modified Kneser-Ney smoothing, as sharded joins.

n-grams are runs of code points as they stand, so no two characters share a symbol and the
count table grows with the text. Tasks count the n-grams of labelled text, Spark sums them and
joins the levels into a table of log probabilities and back-off weights (``model``).

To price texts, the distinct n-grams of each chunk of text, and all shorter runs in them, go as
sorted arrays of 64-bit hashes to the shards of the table, the hash's leading bits. A shard holds its
part of the table as a sorted hash array and answers each array with what it knows. A chunk's
answers then meet its text, compressed, where each character is priced by the longest n-gram known.
Nothing of the table or the texts is gathered anywhere: a shard holds ``SHARD`` n-grams, about. How many
tasks answer follows the text that asks: each shard is copied so often that there is a task for every ``ASKING``
partitions of text, and chunks are dealt to the copies.

Texts to price are read twice (for their n-grams, and to be packed), so the input must be
deterministic, as a table is; a chunk without answers raises. n-grams are told apart by hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textops import mix
from .workspace import lean, stored, tidy

#: Code points in a chunk, and in the slices of it that are worked on at once.
CHUNK, SLICE = 32 << 20, 1 << 19
#: n-grams in a shard of the table, about.
SHARD = 250_000
#: Partitions of text whose questions one task answers, about.
ASKING = 4
#: Odd factor of the hash of an n-gram.
FACTOR = np.uint64(0xD6E8FEB86659FD93)
PAD = " "


def _hashes(points: np.ndarray, order: int) -> np.ndarray:
    """A hash of each run of order code points."""
    h = np.zeros(max(0, len(points) - order + 1), np.uint64)
    for j in range(order):
        h *= FACTOR
        h += points[j : j + len(h)]
    return h


def keys(codes: np.ndarray) -> np.ndarray:
    """Hashes of n-grams, given as rows of code points; of the empty one, too."""
    h = np.zeros(len(codes), np.uint64)
    for j in range(codes.shape[1]):
        h = h * FACTOR + codes[:, j]
    return mix(h + np.uint64(codes.shape[1] + 1))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the texts in a row, each after order - 1 spaces; hash and start of the n-gram that ends at each character; the texts' offsets."""
    pad = PAD * (order - 1)
    points = _points(pad + pad.join(texts))
    ends = np.cumsum([0, *map(len, texts)])
    at = np.arange(ends[-1]) + np.repeat(np.arange(len(texts)) * (order - 1), np.diff(ends))
    return points, _hashes(points, order)[at], at, ends


class Grams:
    """Distinct n-grams of the slices added so far: sorted hashes, their code points and their counts."""

    def __init__(self, order: int) -> None:
        self.order = order
        self.hashes, self.codes, self.counts = np.zeros(0, np.uint64), np.zeros((0, order), np.uint32), np.zeros(0, np.int64)

    def add(self, points: np.ndarray, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Adds the n-grams of a slice; returns where the new ones now are."""
        if not len(h):
            return np.zeros(0, np.int64)
        ordered = np.sort(h)
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        found, n = ordered[first], np.diff([*first, len(ordered)])
        place = np.searchsorted(self.hashes, found)
        known = np.zeros(len(found), bool)
        inside = place < len(self.hashes)
        known[inside] = self.hashes[place[inside]] == found[inside]
        self.counts[place[known]] += n[known]
        new = found[~known]
        if len(new):
            index = np.minimum(np.searchsorted(new, h), len(new) - 1)
            hit = np.flatnonzero(new[index] == h)
            where = np.zeros(len(new), np.int64)
            where[index[hit]] = at[hit]
            codes = points[where[:, None] + np.arange(self.order)]
            self.hashes = np.insert(self.hashes, place[~known], new)
            self.codes = np.insert(self.codes, place[~known], codes, axis=0)
            self.counts = np.insert(self.counts, place[~known], n[~known])
        return place[~known] + np.arange(len(new))


def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """The rows of the batches in slices (one row at least), with a None after each chunk."""
    lean()
    total = 0
    for batch in batches:
        begin = size = 0
        for i, n in enumerate(pa.compute.utf8_length(batch.column("text")).to_pylist()):
            total, size = total + (n or 0), size + (n or 0)
            if size >= SLICE or total >= CHUNK:
                yield batch.slice(begin, i + 1 - begin)
                begin, size = i + 1, 0
            if total >= CHUNK:
                yield None
                total = 0
        if begin < batch.num_rows:
            yield batch.slice(begin)
    yield None
    lean()


def _texts(batch: pa.RecordBatch | pa.Table) -> list[str]:
    return [t or "" for t in batch.column("text").to_pylist()]


def _taught(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Grams] = {}
        for batch in chunked(batches):
            if batch is not None:
                labels, texts = batch.column("label").to_pylist(), _texts(batch)
                for label in dict.fromkeys(labels):
                    points, h, at, _ = grams([t for t, x in zip(texts, labels, strict=True) if x == label], order)
                    held.setdefault(label, Grams(order)).add(points, h, at)
                continue
            for label, found in held.items():
                joined = found.codes.tobytes().decode("utf-32-le", "surrogatepass")
                text = sorted((joined[i * order : (i + 1) * order], n) for i, n in enumerate(found.counts.tolist()))
                yield pa.record_batch([pa.array([label] * len(text), pa.string()), pa.array([t for t, _ in text], pa.string()), pa.array([n for _, n in text], pa.int64())], ["label", "gram", "n"])
            held = {}

    return run


def counts(texts: DataFrame, order: int) -> DataFrame:
    """(label, gram, n) over all rows of (label, text). Null labels are left out."""
    partial = texts.where("label IS NOT NULL").select("label", "text").mapInArrow(_taught(order), "label string, gram string, n long")
    return partial.groupBy("label", "gram").agg(F.sum("n").alias("n"))


def _discounts() -> list[Column]:
    """Modified Kneser-Ney discounts for counts of 1, 2 and 3 or more, out of how many n-grams have each count."""
    n1, n2, n3, n4 = (F.greatest(F.lit(1), F.count_if(F.col("n") == i)).cast("double") for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    within = lambda d, most: F.least(F.greatest(d, F.lit(0.1)), F.lit(most))
    return [within(1 - 2 * y * n2 / n1, 0.95).alias("d1"), within(2 - 3 * y * n3 / n2, 1.9).alias("d2"), within(3 - 4 * y * n4 / n3, 2.9).alias("d3")]


def model(counted: DataFrame, order: int) -> DataFrame:
    """(label, gram, p, backoff) of a count table: log probability of a gram's last character after
    the others (of the empty gram: of any character), and log weight of what follows a gram that is known by shorter grams.

    p is null for a gram that is only a context, backoff for one that is no context.
    """
    levels = [counted]
    for k in range(order - 1, 0, -1):  # continuation counts: how many different characters precede
        levels.append(stored(levels[-1].groupBy("label", F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n")), "charlm-level"))
    none = F.lit(None).cast("double")
    lower = levels[-1].groupBy("label").agg(F.lit("").alias("end"), (1 / (F.count("*") + 1)).alias("below"))
    rows = [lower.select("label", F.col("end").alias("gram"), F.log("below").alias("p"), none.alias("backoff"))]
    for k, level in enumerate(reversed(levels), 1):
        d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        own = level.join(F.broadcast(level.groupBy("label").agg(*_discounts())), "label").select("label", "gram", F.substring("gram", 1, k - 1).alias("context"), F.substring("gram", 2, k - 1).alias("end"), "n", d.alias("d"))
        sums = own.groupBy("label", "context").agg(F.sum("n").alias("total"), (F.sum("d") / F.sum("n")).alias("left"))
        p = (F.col("n") - F.col("d")) / F.col("total") + F.col("left") * F.col("below")
        priced = own.join(sums, ["label", "context"]).join(lower, ["label", "end"])
        lower = stored(priced.select("label", F.col("gram").alias("end"), p.alias("below")), "charlm-prices")
        rows += [lower.select("label", F.col("end").alias("gram"), F.log("below").alias("p"), none.alias("backoff"))]
        rows += [sums.select("label", F.col("context").alias("gram"), none.alias("p"), F.log("left").alias("backoff"))]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.groupBy("label", "gram").agg(F.max("p").alias("p"), F.max("backoff").alias("backoff"))


def _keyed(bits: int):
    """Rows of the table by shard and hash, with p and backoff for each label in cells, as bytes, NaN where null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("gram").to_pylist()
            length = np.array([len(t) for t in texts], np.int64)
            points, end = _points("".join(texts)), np.cumsum(length)
            key = np.zeros(len(texts), np.uint64)
            for k in np.unique(length):
                of = np.flatnonzero(length == k)
                key[of] = keys(points[(end[of] - k)[:, None] + np.arange(k)])
            cells = batch.column("cells")
            flat = cells.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
            width = len(flat) // max(1, len(cells))
            packed = pa.array([flat[i * width : (i + 1) * width].tobytes() for i in range(len(cells))], pa.binary())
            yield pa.record_batch([pa.array((key >> np.uint64(64 - bits)).astype(np.int64)), pa.array(key.view(np.int64)), packed], ["shard", "key", "cells"])

    return run


def _asked(order: int, bits: int):
    """A chunk's distinct n-grams and their parts, hashed and sorted, in an array for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, name = Grams(order), hashlib.blake2b(digest_size=8)
        for batch in chunked(batches):
            if batch is not None:
                texts = _texts(batch)
                _named(name, texts)
                held.add(*grams(texts, order)[:3])
                continue
            wanted = np.unique(np.concatenate([keys(np.zeros((1, 0), np.uint32)), *(keys(held.codes[:, a:b]) for a in range(order) for b in range(a + 1, order + 1))]))
            cuts = np.searchsorted(wanted, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
            parts = [wanted[a:b].tobytes() for a, b in zip(cuts, [*cuts[1:], len(wanted)], strict=True)]
            yield pa.record_batch([pa.array([_number(name)] * len(parts), pa.int64()), pa.array(np.arange(len(parts))), pa.array(parts, pa.binary())], ["chunk", "shard", "keys"])
            held, name = Grams(order), hashlib.blake2b(digest_size=8)

    return run


def _named(name, texts: list[str]) -> None:
    """A chunk is named by its text, so that both readings agree on it wherever they run."""
    for t in texts:
        name.update(t.encode("utf-8", "surrogatepass") + b"\xff")


def _number(name) -> int:
    return int.from_bytes(name.digest(), "little", signed=True)


def _answers(labels: int):
    """For each shard its rows of the table, and after them the arrays of the chunks: what of them is known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, table = None, [], None
        for batch in batches:
            out = []
            of, chunk = batch.column("shard").to_numpy(), batch.column("chunk")
            for a in np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1])]) if len(of) else []):
                b = a + int(np.searchsorted(of[a:], of[a], "right"))
                if of[a] != shard:
                    shard, parts, table = of[a], [], None
                rows, of_table = batch.slice(a, b - a), int(chunk.slice(a, b - a).null_count)
                if of_table:
                    held = rows.slice(0, of_table)
                    parts.append((held.column("key").to_numpy().view(np.uint64), np.frombuffer(b"".join(held.column("blob").to_pylist()), np.float32).reshape(-1, 2 * labels)))
                for i in range(of_table, rows.num_rows):
                    if table is None:
                        key = np.concatenate([np.zeros(0, np.uint64), *(k for k, _ in parts)])
                        by = np.argsort(key)
                        table = key[by], np.concatenate([np.zeros((0, 2 * labels), np.float32), *(c for _, c in parts)])[by]
                    wanted = np.frombuffer(rows.column("blob")[i].as_py(), np.uint64)
                    place = np.searchsorted(table[0], wanted)
                    place[place == len(table[0])] = 0
                    hit = table[0][place] == wanted if len(table[0]) else np.zeros(len(wanted), bool)
                    out.append((rows.column("chunk")[i].as_py(), wanted[hit].tobytes(), table[1][place[hit]].tobytes()))
            columns = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.binary(), pa.binary()], strict=True)], ["chunk", "keys", "body"])
        lean()

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunks' rows, a compressed body for each slice."""
    held, name = [], hashlib.blake2b(digest_size=8)
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 5))
    for batch in chunked(batches):
        if batch is not None:
            _named(name, _texts(batch))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=options) as out:
                out.write_batch(batch)
            held.append(sink.getvalue().to_pybytes())
            continue
        for body in held:
            yield pa.record_batch([pa.array([_number(name)], pa.int64()), pa.array([body], pa.binary())], ["chunk", "body"])
        held, name = [], hashlib.blake2b(digest_size=8)


def prices(codes: np.ndarray, known: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """-log p of the last character of each n-gram under each label, out of the rows of the table whose sorted hashes are known.

    cells: p and backoff of each label in turn, NaN where null.
    """
    order, labels = codes.shape[1], cells.shape[1] // 2

    def look(part: np.ndarray) -> np.ndarray:
        key = keys(part)
        place = np.searchsorted(known, key)
        place[place == len(known)] = 0
        out = cells[place].astype(np.float64)
        out[known[place] != key] = np.nan
        return out.reshape(len(part), labels, 2)

    p = look(codes[:, :0])[:, :, 0]
    for k in range(1, order + 1):
        backoff = np.nan_to_num(look(codes[:, order - k : order - 1])[:, :, 1])
        own = look(codes[:, order - k :])[:, :, 0]
        p = np.where(np.isnan(own), backoff + p, own)
    return -p


class _Chunk:
    """The answers of one chunk, then its bodies priced."""

    def __init__(self, name: int, order: int, labels: int) -> None:
        self.name, self.labels, self.answers = name, labels, []
        self.seen, self.cost, self.table = Grams(order), np.zeros((0, labels)), None

    def priced(self, body: bytes) -> pa.RecordBatch:
        batch = pa.ipc.open_stream(body).read_next_batch()
        if self.table is None:
            key = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(k, np.uint64) for k, _ in self.answers)])
            if not len(key):
                raise ValueError("a chunk of text differs from the one whose n-grams were priced: the input is not deterministic")
            by = np.argsort(key)
            self.table = key[by], np.concatenate([np.frombuffer(c, np.float32).reshape(-1, 2 * self.labels) for _, c in self.answers])[by]
        points, h, at, ends = grams(_texts(batch), self.seen.order)
        new = self.seen.add(points, h, at)
        self.cost = np.insert(self.cost, new - np.arange(len(new)), prices(self.seen.codes[new], *self.table), axis=0)
        place, n = np.searchsorted(self.seen.hashes, h), np.diff(ends)
        means = np.zeros((batch.num_rows, self.labels))
        for j in range(self.labels):
            total = np.concatenate([[0], np.cumsum(self.cost[place, j])])
            means[:, j] = (total[ends[1:]] - total[ends[:-1]]) / np.maximum(n, 1)
        costs = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * self.labels, pa.int32()), pa.array(means.ravel()))
        return pa.record_batch([batch.column("row"), costs, pa.array(n.astype(np.int64))], ["row", "costs", "chars"])


def _priced(order: int, labels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for name, known, body in zip(batch.column("chunk").to_pylist(), batch.column("keys"), batch.column("body"), strict=True):
                if held is None or held.name != name:
                    held = _Chunk(name, order, labels)
                if known.is_valid:
                    held.answers.append((known.as_py(), body.as_py()))
                else:
                    yield held.priced(body.as_py())
        lean()

    return run


def copied(partitions: int, shards: int) -> int:
    """Copies of each shard of the table, so that answering tasks grow with the partitions of text."""
    return max(1, -(-partitions // (ASKING * shards)))


def scored(taught: DataFrame, rows: DataFrame, order: int) -> tuple[list[str], DataFrame]:
    """The sorted labels of taught (label, text), and for each of rows (row struct, text): row, costs (mean cost a character under each label, 0 for empty texts), chars."""
    counted = stored(counts(taught, order), "charlm-counts")
    labels = sorted(r["label"] for r in counted.select("label").distinct().collect())
    if not labels:
        return labels, rows.select("row", F.array().cast("array<double>").alias("costs"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"))
    cell = lambda c, label: F.max(F.when(F.col("label") == label, F.col(c))).cast("float")
    table = model(counted, order).groupBy("gram").agg(F.array(*[cell(c, x) for x in labels for c in ("p", "backoff")]).alias("cells"))
    table = stored(table, "charlm-model")
    shards = max(8, -(-table.count() // SHARD))
    bits = (shards - 1).bit_length()
    packed = table.select("gram", "cells").mapInArrow(_keyed(bits), "shard long, key long, cells binary")
    asked = rows.select("text").mapInArrow(_asked(order, bits), "chunk long, shard long, keys binary")
    copies = copied(rows.select("text").rdd.getNumPartitions(), 1 << bits)
    each = packed.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    held = each.select((F.col("shard") * copies + F.col("copy")).alias("shard"), F.lit(None).cast("long").alias("chunk"), "key", F.col("cells").alias("blob"))
    both = held.unionByName(asked.select((F.col("shard") * copies + F.pmod("chunk", F.lit(copies))).alias("shard"), "chunk", F.lit(None).cast("long").alias("key"), F.col("keys").alias("blob")))
    answers = both.repartition(copies << bits, "shard").sortWithinPartitions("shard", F.col("chunk").asc_nulls_first()).mapInArrow(_answers(len(labels)), "chunk long, keys binary, body binary")
    kind = rows.schema["row"].dataType.simpleString()  # the cast lets every field be null
    bodies = rows.select(F.col("row").cast(kind).alias("row"), "text").mapInArrow(_packed, "chunk long, body binary")
    met = answers.unionByName(bodies.select("chunk", F.lit(None).cast("binary").alias("keys"), "body"))
    met = met.repartition("chunk").sortWithinPartitions("chunk", F.col("keys").isNull())
    tidy(rows.sparkSession)
    return labels, met.mapInArrow(_priced(order, len(labels)), f"row {kind}, costs array<double>, chars long")
