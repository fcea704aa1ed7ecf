"""Hierarchical packing of token ids into sequences of several context sizes.

A document's full windows become sequences of their own. What is left of it goes to the tier
of the smallest context size that holds it; each tier is packed longest first, the gap of a
long window is filled from shorter documents, the last of which is cut to fit, so every
sequence is exactly full. What a buffer leaves is carried to the next, and the last rest of
a task is cut into windows of powers of two. Packing needs no shuffle: each task packs the
documents it reads, a bounded buffer at a time.

Steps are balanced: the sequences of a tier that come from one buffer are dealt to groups of
``STEP_TOKENS`` tokens, about, dearest first and back and forth, so that groups are alike in number and
in cost (the sum of squared lengths of the pieces, what attention within documents takes).
Which documents share a buffer, and so a sequence, follows Spark's splits of the input.

Defined cases: a null text is empty and holds just the end id; repeated rows are packed each;
null ids pass through; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import small_batches

#: Context sizes, longest first; powers of two.
TIERS = (2048, 1024, 512, 256)
BUFFER_IDS = 1 << 20
STEP_TOKENS = 1 << 16
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
#: (length, document's place in the buffer, start in the document)
Part = tuple[int, int, int]


def fill(gap: int, pool: list[Part]) -> list[Part]:
    """Takes parts of exactly gap tokens in all out of pool (sorted), largest fitting first; the last is cut."""
    out = []
    while gap:
        at = bisect.bisect_right(pool, (gap, 1 << 62, 1 << 62)) - 1
        if at >= 0:
            part = pool.pop(at)
        else:
            n, doc, start = pool.pop(0)
            part = (gap, doc, start)
            bisect.insort(pool, (n - gap, doc, start + gap))
        out.append(part)
        gap -= part[0]
    return out


def pack(parts: list[Part], tiers: tuple[int, ...] = TIERS) -> tuple[list[tuple[int, list[Part]]], list[Part]]:
    """Full sequences (tier, parts) of a buffer, and the parts that fill no window, less than tiers[0] in all."""
    out, rest = [], []
    for n, doc, start in parts:
        while n >= tiers[0]:
            out.append((tiers[0], [(tiers[0], doc, start)]))
            n, start = n - tiers[0], start + tiers[0]
        if n:
            rest.append((n, doc, start))
    rest.sort()
    left: list[Part] = []
    for tier, below in zip(tiers, [*tiers[1:], 0], strict=True):
        cut = bisect.bisect_right(rest, (below, 1 << 62, 1 << 62))
        mine, rest = rest[cut:], rest[:cut]
        pool = rest if below else mine
        total = sum(p[0] for p in pool)
        while below and mine:
            part = mine.pop()
            gap = tier - part[0]
            if gap > total:
                left.append(part)
                continue
            out.append((tier, [part, *fill(gap, pool)]))
            total -= gap
        while not below and total >= tier:
            out.append((tier, fill(tier, pool)))
            total -= tier
        if not below:
            left += pool
    left.sort(key=lambda p: (p[1], p[2]))
    while sum(p[0] for p in left) >= tiers[0]:
        window, gap = [], tiers[0]
        while gap:
            n, doc, start = left.pop(0)
            window.append((min(n, gap), doc, start))
            if n > gap:
                left.insert(0, (n - gap, doc, start + gap))
            gap -= window[-1][0]
        out.append((tiers[0], window))
    return out, left


def last(parts: list[Part]) -> list[tuple[int, list[Part]]]:
    """Windows of powers of two, longest first, that hold the parts without padding."""
    out, pool = [], sorted(parts)
    total = sum(p[0] for p in pool)
    for bit in reversed(range(total.bit_length())):
        if total >> bit & 1:
            out.append((1 << bit, fill(1 << bit, pool)))
    return out


def balanced(costs: list[int], groups: int) -> list[int]:
    """A group for each cost: dearest first, dealt back and forth, so that groups are alike in number and cost."""
    out = [0] * len(costs)
    for place, i in enumerate(sorted(range(len(costs)), key=lambda i: -costs[i])):
        turn, at = divmod(place, groups)
        out[i] = at if turn % 2 == 0 else groups - 1 - at
    return out


def _packed(path: str, end_id: int, tiers: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import encoder

        encode, end = encoder(path), np.array([end_id], "<u4").tobytes()
        task = TaskContext.get().partitionId()
        docs: list[tuple[int | None, bytes]] = []
        parts: list[Part] = []
        counts: dict[int, int] = {}
        sequence = size = 0

        def emit(sequences: list[tuple[int, list[Part]]]) -> pa.RecordBatch:
            nonlocal sequence
            rows, steps = [], {}
            for tier in sorted({t for t, _ in sequences}):
                costs = [sum(n * n for n, _, _ in held) for t, held in sequences if t == tier]
                groups = max(1, round(len(costs) * tier / STEP_TOKENS))
                base = (task << 40) + (tier.bit_length() << 32) + counts.get(tier, 0)
                steps[tier] = iter([base + g for g in balanced(costs, groups)])
                counts[tier] = counts.get(tier, 0) + groups
            for tier, held in sequences:
                step, offset = next(steps[tier]), 0
                for n, doc, start in held:
                    key, ids = docs[doc]
                    rows.append((key, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), len(ids) // 4, (task << 40) + sequence, offset, tier, step))
                    offset += n
                sequence += 1
            columns = list(zip(*rows, strict=True)) or [[]] * 9
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = encode.ids(text.as_py()) + end
                parts.append((len(ids) // 4, len(docs), 0))
                docs.append((key, ids))
                size += len(ids) // 4
                if size >= BUFFER_IDS:
                    full, left = pack(parts, tiers)
                    yield emit(full)
                    used = sorted({p[1] for p in left})
                    docs = [docs[i] for i in used]
                    place = {old: new for new, old in enumerate(used)}
                    parts = [(n, place[doc], start) for n, doc, start in left]
                    size = 0
        full, left = pack(parts, tiers)
        if full or left:
            yield emit([*full, *last(left)])

    return run


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, tiers: tuple[int, ...] = TIERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece, as SCHEMA says; a sequence's length is a tier or, at a task's end, a power of two."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(_packed(tokenizer, end_id, tiers), SCHEMA)
