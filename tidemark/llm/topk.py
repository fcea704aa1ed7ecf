"""Exact top-k by inner product: columnar branch and bound over blocks.

Candidates are dealt into blocks by a hash of their vector, so that equal vectors meet and are scored once, as a class
with its k + 1 smallest ids. A block is a matrix stored dimension by dimension, those with the most mass first.
A task reads one block of candidates and then lets all parts of the queries pass by it, one after the other. Scores of
a part and a tile of the block are one matrix product over the first dimensions; as soon as thresholds have
formed, the product of the masses that are left (Cauchy-Schwarz) is added as one dimension more, and only pairs whose bound
still reaches the query's k-th best so far are scored to the end. How many dimensions come first is chosen by what
a sample of the tile would keep; where no cut pays, all of them do. A block and a part yield at most k rows a query,
packed; the rows of a part are merged in one group. The queries are a stated set, scored against all rows.

Products are of 32-bit floats where the largest norms' product is below 2^24, of 64-bit ones below 2^53: all partial
sums are integers that these hold, so scores are exact. Beyond, scores are integers, without bounds.

Defined cases: a vector that is null, or holds null, NaN or infinity, takes no part; nor
does a row without an id, as a query or a candidate; a candidate with the query's own id is the query itself
and not returned; vectors of another length than the query's are no candidates of it; rows repeated under one id
count once per distinct vector; ties go to the smaller id. Components count as floor(scale * x), at most 64 bits;
scores beyond 64 bits are ranked exactly within a block and a part and returned as the nearest 64-bit number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import lean, small_batches

SCALE = 1024
#: Candidates of a block: as many as make up to BLOCKS blocks, between the two.
BLOCK, LARGE_BLOCK, BLOCKS = 1 << 15, 1 << 18, 32
QUERY_BLOCK = 1024
#: Candidates that give the first thresholds, and candidates of a tile.
FIRST, TILE = 512, 1024
STEP = 4
#: What scoring one pair to the end costs, in dimensions of a matrix product, found by trial: it gathers two rows.
REST = 16000
_VECTORS = "dims int, hash long, id long, v binary"
_FOUND = "part int, query_ids binary, vec_ids binary, scores binary"
RESULT = "query_id long, rank int, vec_id long, score long"
_INT64 = np.iinfo(np.int64)


# -- vectors as rows of bytes ----------------------------------------------------------------------
def _hashes(m: np.ndarray) -> np.ndarray:
    """64 bits of each row of integers."""
    odd = np.random.default_rng(m.shape[1]).integers(0, 1 << 63, m.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    h = m.astype("<i8").view(np.uint64) @ odd if m.shape[1] else np.zeros(len(m), np.uint64)
    for shift in (32, 29):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def _classes(m: np.ndarray, ids: np.ndarray, hashes: np.ndarray, most: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows that stay (of equal vectors those with the most smallest ids, each id once), equal ones together, and the number of each one's class."""
    order = np.lexsort((ids, hashes))
    same = hashes[order[1:]] == hashes[order[:-1]]
    at = np.flatnonzero(same)
    if (m[order[at]] != m[order[at + 1]]).any():  # different vectors of one hash
        numbers = np.unique(m, axis=0, return_inverse=True)[1].reshape(-1)
        order = np.lexsort((ids, numbers))
        same = numbers[order[1:]] == numbers[order[:-1]]
    fresh = np.append(np.ones(min(1, len(order)), bool), ~(same & (ids[order[1:]] == ids[order[:-1]])))
    number = np.cumsum(np.append(np.zeros(min(1, len(order)), int), ~same))[fresh]
    order = order[fresh]
    if most is not None:
        kept = np.arange(len(order)) - np.searchsorted(number, number) < most
        order, number = order[kept], number[kept]
    return order, number


def _integers(x: np.ndarray, scale: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = np.floor(x * float(scale))
    if (np.abs(x) < 2.0**15).all():
        return x.astype("<i2")
    out = np.where(np.abs(x) < 2.0**63, x, 0).astype("<i8")
    out[x >= 2.0**63], out[x <= -(2.0**63)] = _INT64.max, _INT64.min
    return out


def _bytes(m: np.ndarray) -> list[bytes]:
    """Each row in the narrowest integers that hold it, so that equal rows are equal bytes."""
    out: list[bytes] = [b""] * len(m)
    if m.shape[1] == 0 or not len(m):
        return out
    low, high, left = m.min(1), m.max(1), np.ones(len(m), bool)
    for kind in ("<i2", "<i4", "<i8"):
        span = np.iinfo(kind)
        mine = np.flatnonzero(left & (low >= span.min) & (high <= span.max))
        data, n = m[mine].astype(kind).tobytes(), m.shape[1] * int(kind[-1])
        for i, r in enumerate(mine):
            out[r] = data[i * n : (i + 1) * n]
        left[mine] = False
    return out


def _scaled(scale: int, most: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, vector) to rows of _VECTORS: usable vectors, of equal ones of a batch those with the most smallest ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            there = pc.is_valid(lists).to_numpy(zero_copy_only=False)
            starts, flat = np.cumsum(lengths) - lengths, lists.flatten().to_numpy(zero_copy_only=False).astype(float)
            for dims in np.unique(lengths[there]):
                rows = np.flatnonzero(there & (lengths == dims))
                x = flat.reshape(-1, dims) if dims and len(rows) * dims == len(flat) else flat[starts[rows][:, None] + np.arange(dims)]
                fine = np.isfinite(x).all(1)
                m, own = _integers(x[fine], scale), ids[rows[fine]].astype(np.int64)
                hashes = _hashes(m)
                order, _ = _classes(m, own, hashes, most)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(order), dims, np.int32)), pa.array(hashes[order]), pa.array(own[order]), pa.array(_bytes(m[order]), pa.binary())], names=["dims", "hash", "id", "v"])

    return run


def _matrices(v: pa.BinaryArray, dims: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of equally wide vectors."""
    lengths = pc.binary_length(v).to_numpy(zero_copy_only=False)
    if not dims:
        yield np.arange(len(v)), np.zeros((len(v), 0), "<i2")
        return
    for size in np.unique(lengths):
        rows = np.flatnonzero(lengths == size)
        yield rows, np.frombuffer(b"".join(v.take(pa.array(rows)).to_pylist()), f"<i{size // dims}").reshape(-1, dims)


# -- a block of candidates and a part of the queries -------------------------------------------------
class Block:
    """Candidates of one length: a row a class of equal vectors, in order of their smallest ids; entries are (class, id)."""

    def __init__(self, m: np.ndarray, ids: np.ndarray, hashes: np.ndarray, k: int):
        order, number = _classes(m, ids, hashes, k + 1)
        first = np.flatnonzero(np.append(np.ones(min(1, len(number)), bool), number[1:] != number[:-1]))
        ends = np.append(first[1:], len(number))
        by_id = np.argsort(ids[order[first]], kind="stable")
        self.sizes = (ends - first)[by_id]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.ids = ids[order[np.repeat(first[by_id] - self.starts, self.sizes) + np.arange(len(order))]]
        self.single = bool((self.sizes == 1).all())
        self.m = m[order[first[by_id]]]
        self.by_entry = np.argsort(self.ids, kind="stable")
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)[self.by_entry]
        mass = np.zeros(self.m.shape[1])
        self.norms = np.zeros(len(self.m))
        for a in range(0, len(self.m), 1 << 14):
            squares = self.m[a : a + (1 << 14)].astype(float) ** 2
            mass += squares.sum(0)
            self.norms[a : a + (1 << 14)] = np.sqrt(squares.sum(1))
        self.order = np.argsort(-mass, kind="stable")
        self._kept: dict = {}

    def rows(self, kind: type) -> np.ndarray:
        if self._kept.get("kind") is not kind:
            self._kept = {"kind": kind, "rows": self.m[:, self.order].astype(kind)}
        return self._kept["rows"]

    def tile(self, kind: type, d: int, a: int, b: int) -> np.ndarray:
        """The first d dimensions of some rows, and below them the mass of the others where there are any, dimension by dimension."""
        rows = self.rows(kind)
        if self._kept.get("d") != d:
            self._kept |= {"d": d, "tiles": {}}
        if a not in self._kept["tiles"]:
            self._kept["tiles"][a] = bounding(rows[a:b], d).T.copy()
        return self._kept["tiles"][a]

    def own(self, query_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, class) where the class has no other id than the query's, by class."""
        held = self.ids[self.by_entry]
        low, high = np.searchsorted(held, query_ids), np.searchsorted(held, query_ids, "right")
        at = np.repeat(low - np.cumsum(high - low) + (high - low), high - low) + np.arange((high - low).sum())
        q, c = np.repeat(np.arange(len(query_ids)), high - low), self.owner[at]
        alone = self.sizes[c] == 1
        q, c = q[alone], c[alone]
        order = np.argsort(c, kind="stable")
        return q[order], c[order]

    def entries(self, q: np.ndarray, c: np.ndarray, score: np.ndarray, query_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of pairs of a query and a class, without the query's own."""
        n = self.sizes[c]
        if self.single:
            return q, self.ids[c], score
        at = np.repeat(self.starts[c] - np.cumsum(n) + n, n) + np.arange(n.sum())
        q, ids, score = np.repeat(q, n), self.ids[at], np.repeat(score, n)
        other = ids != query_ids[q]
        return q[other], ids[other], score[other]


def bounding(rows: np.ndarray, d: int) -> np.ndarray:
    """Rows whose inner product is at least that of the whole rows, but for rounding: the first d dimensions and the norm of the others."""
    if d == rows.shape[1]:
        return rows
    out = np.empty((len(rows), d + 1), rows.dtype)
    out[:, :d] = rows[:, :d]
    out[:, d] = np.sqrt((rows[:, d:].astype(float) ** 2).sum(1)) * (1 + 1e-6)
    return out


def _set(mask: np.ndarray) -> np.ndarray:
    """Flat places of what is set, eight at once where it can be."""
    flat = mask.reshape(-1)
    if len(flat) % 8:
        return np.flatnonzero(flat)
    eights = np.flatnonzero(flat.view(np.uint64) != 0)
    at, more = np.nonzero(flat.reshape(-1, 8)[eights])
    return eights[at] * 8 + more


def best(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query, by query, score and id."""
    order = np.lexsort((ids, -score, q))
    s = q[order]
    return order[np.arange(len(s)) - np.searchsorted(s, s) < k]


def _first(q: np.ndarray, rows: np.ndarray, need: np.ndarray) -> int:
    """How many dimensions should come first, by a sample of queries and rows."""
    q, rows, dims = q[:64], rows[:512], q.shape[1]
    share = lambda d: (bounding(q, d) @ bounding(rows, d).T >= need[:64, None]).mean()
    cost, least = {dims: float(dims)}, share(dims)
    for d in range(STEP, dims - 1, STEP):
        cost[d] = d + 1 + REST * (share(d) - least)
    return min(cost, key=cost.get)


def search(q: np.ndarray, query_ids: np.ndarray, block: Block, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of a block for each query: (query's id, id, score), as long as there are as many."""
    n, dims = block.m.shape
    norms = np.sqrt((q.astype(float) ** 2).sum(1))
    reach = norms.max(initial=0) * block.norms.max(initial=0) * (1 + 1e-6)
    if reach >= 1 << 53:
        return _wide(q, query_ids, block, k)
    kind = np.float32 if reach < 1 << 24 else np.float64
    q = q[:, block.order].astype(kind)
    rows = block.rows(kind)
    own_q, own_c = block.own(query_ids)
    slack = (np.finfo(kind).eps * 4 * (dims + 2) * block.norms.max(initial=0) * norms + 1e-6).astype(kind)
    threshold, d, asked, tested = np.full(len(q), -np.inf, kind), dims, q, False
    held = (np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0, kind))
    new, merged, edge = [], 0, 0
    room = np.empty(len(q) * max(FIRST, TILE), kind)
    while edge < n:
        a, edge = edge, min(n, edge + (TILE if edge else FIRST))
        if not tested and a >= max(FIRST, n // 8):
            d, tested = _first(q, rows[a:edge], threshold - slack), True
            asked = bounding(q, d)
        reached = np.matmul(asked, block.tile(kind, d, a, edge), out=room[: len(q) * (edge - a)].reshape(len(q), -1))
        mine = slice(*np.searchsorted(own_c, [a, edge]))
        reached[own_q[mine], own_c[mine] - a] = -np.inf
        if not a and edge >= k:
            threshold = np.partition(reached, edge - k, axis=1)[:, edge - k]
        # Classes come by their smallest ids, so of single ones a later one with an equal score is no better.
        need = threshold + 1 if a and block.single else threshold
        hits = _set(reached >= (need if d == dims else need - slack)[:, None])
        at, c = np.divmod(hits, edge - a)
        if d < dims:
            score = np.einsum("ij,ij->i", q[at], rows[a + c])
            good = (score >= need[at]) & (reached[at, c] > -np.inf)
        else:
            score = reached[at, c]
            good = score > -np.inf
        at, c, score = at[good], c[good], score[good]
        new.append(block.entries(at, a + c, score, query_ids))
        if edge == n or edge >= 3 * merged or sum(len(x[0]) for x in new) > 4 * k * len(q):
            held = tuple(np.concatenate(x) for x in zip(held, *new, strict=True))
            kept = best(held[0], held[1], held[2], k)
            held, new, merged = tuple(x[kept] for x in held), [], edge
            full = np.flatnonzero(np.bincount(held[0], minlength=len(q)) == k)
            last = np.searchsorted(held[0], full, "right") - 1
            threshold[full] = held[2][last]
    return query_ids[held[0]], held[1], held[2].astype(np.int64)


def _wide(q: np.ndarray, query_ids: np.ndarray, block: Block, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """search() for scores that floats don't hold: in 64-bit integers, or else in Python's."""
    reach = np.sqrt((q.astype(float) ** 2).sum(1)).max() * block.norms.max() * (1 + 1e-6)
    kind = np.int64 if reach < 1 << 63 else object
    m, found = block.m.astype(kind), []
    for j, one in enumerate(q.astype(kind)):
        score = m @ one
        others = np.ones(len(m), bool)
        others[block.own(query_ids[j : j + 1])[1]] = False
        c = np.flatnonzero(others)
        if len(c) > k:
            c = c[score[c] >= np.sort(score[c])[-k]]
        _, ids, s = block.entries(np.zeros(len(c), int), c, score[c], query_ids[j : j + 1])
        found += [(int(query_ids[j]), i, max(_INT64.min, min(_INT64.max, x))) for x, i in sorted(((int(x), int(i)) for x, i in zip(s, ids, strict=True)), key=lambda x: (-x[0], x[1]))[:k]]
    return tuple(np.array([x[i] for x in found], np.int64) for i in range(3))


def _scored(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of blocks, each block's candidates before the parts that are sent to it, to _FOUND."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        number, held, blocks = None, {}, {}
        for batch in batches:
            at, part = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("block", "part"))
            cuts = np.flatnonzero((at[1:] != at[:-1]) | (part[1:] != part[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(at)], strict=True):
                if a == b:
                    continue
                if at[a] != number:
                    number, held, blocks = at[a], {}, {}
                rows = batch.slice(a, b - a)
                lengths = rows.column("dims").to_numpy(zero_copy_only=False)
                if part[a] < 0:
                    for dims in np.unique(lengths):
                        mine = rows.take(pa.array(np.flatnonzero(lengths == dims)))
                        ids, hashes = (mine.column(x).to_numpy(zero_copy_only=False) for x in ("id", "hash"))
                        held.setdefault(dims, []).extend((m, ids[r], hashes[r]) for r, m in _matrices(mine.column("v"), dims))
                    continue
                for dims, ids, v in zip(lengths, rows.column("ids"), rows.column("v"), strict=True):
                    if dims in held:
                        blocks[dims] = Block(*(np.concatenate(x) for x in zip(*held.pop(dims), strict=True)), k)
                    if dims not in blocks:
                        continue
                    query_ids = np.frombuffer(ids.as_py(), "<i8")
                    data = v.as_py()
                    q = np.frombuffer(data, f"<i{len(data) // len(query_ids) // dims}").reshape(-1, dims) if dims else np.zeros((len(query_ids), 0), np.int64)
                    for s in range(0, len(q), 2 * QUERY_BLOCK):
                        found = search(q[s : s + 2 * QUERY_BLOCK], query_ids[s : s + 2 * QUERY_BLOCK], blocks[dims], k)
                        if len(found[0]):
                            yield pa.RecordBatch.from_arrays([pa.array([part[a]], pa.int32()), *(pa.array([x.astype("<i8").tobytes()], pa.binary()) for x in found)], names=["part", "query_ids", "vec_ids", "scores"])
        held, blocks = {}, {}
        lean()

    return run


# -- the operator --------------------------------------------------------------------------------
def _together(table: pa.Table) -> pa.Table:
    """One row of all queries of a part and a length."""
    dims, ids = table.column("dims")[0].as_py(), table.column("id").to_numpy()
    rows = list(_matrices(table.column("v").combine_chunks(), dims))
    m, at = np.concatenate([x for _, x in rows]), np.concatenate([r for r, _ in rows])
    ids, hashes = ids[at], table.column("hash").to_numpy()[at]
    order, _ = _classes(m, ids, hashes, None)
    return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "dims": pa.array([dims], pa.int32()), "ids": pa.array([ids[order].astype("<i8").tobytes()], pa.binary()), "v": pa.array([m[order].tobytes()], pa.binary())})


def _merged(k: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        q, ids, score = (np.frombuffer(b"".join(table.column(x).to_pylist()), "<i8") for x in ("query_ids", "vec_ids", "scores"))
        # The greatest score first: ~x turns the order of integers round, where -x overflows.
        order = np.lexsort((ids, ~score, q))
        rank = np.arange(len(order)) - np.searchsorted(q[order], q[order]) + 1
        order, rank = order[rank <= k], rank[rank <= k]
        return pa.table({"query_id": q[order], "rank": pa.array(rank, pa.int32()), "vec_id": ids[order], "score": score[order]})

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of all other rows for each query row."""
    small_batches(vectors.sparkSession)
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
    kind = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"
    narrow = lambda df, most: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v")).where("id IS NOT NULL").mapInArrow(_scaled(scale, most), _VECTORS)
    n, m = vectors.count(), vectors.where(is_query).count()
    blocks = max(1, -(-n // LARGE_BLOCK), min(BLOCKS, -(-n // BLOCK)))
    part = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-m // QUERY_BLOCK)))).cast("int")
    asked = narrow(rows.where(is_query), None).withColumn("part", part).groupBy("part", "dims").applyInArrow(_together, "part int, dims int, ids binary, v binary")
    # Every part of the queries goes to every block, where it comes after the candidates.
    sent = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "part", "dims", "ids", "v")
    dealt = narrow(rows, k + 1).select(F.pmod("hash", F.lit(blocks)).cast("int").alias("block"), F.lit(-1).alias("part"), "dims", "hash", "id", "v")
    both = dealt.unionByName(sent, allowMissingColumns=True)
    found = both.repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "part").mapInArrow(_scored(k), _FOUND)
    return found.groupBy("part").applyInArrow(_merged(k), RESULT)
