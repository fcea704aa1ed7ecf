"""Vectorised helpers on Arrow string columns: words, word hashes, shingles.

Everything works on the concatenated bytes of a slice of rows, so no helper loops
over words in Python. A slice holds at most about ``CHUNK`` bytes, or one longer text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .workspace import lean

CHUNK = 1 << 20
#: Bytes of a slice where memory is short.
SMALL = 1 << 18
SPACES = [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]
U = np.uint64
_BASE, _STEP = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit of 64-bit integers (the finaliser of splitmix64)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


IS_SPACE = np.zeros(256, bool)
IS_SPACE[SPACES] = True
#: For words of letters and digits only: every other ASCII byte separates.
NOT_ALNUM = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE_VALUE = mix(np.arange(1, 257, dtype=U) * _BASE)
_LOWER_VALUE = _BYTE_VALUE[LOWER]


def column(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (len + 1, from 0) of a string column; nulls are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("")
    wide = pa.types.is_large_string(array.type)
    off = np.frombuffer(array.buffers()[1], np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    held = array.buffers()[2] if len(array) else None
    data = np.frombuffer(held, np.uint8)[off[0] : off[-1]] if held is not None else np.zeros(0, np.uint8)
    return data, off.astype(np.int64) - int(off[0])


def slices(batches: Iterator[pa.RecordBatch], text: str, size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices of about ``size`` bytes of text, at least a row each."""
    lean()
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = column(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + size, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    lean()


@lru_cache(maxsize=2)
def held_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = U(pow(int(_STEP), -1, 1 << 64))
    up, down = np.full(n, _STEP), np.full(n, inverse)
    up[:1] = down[:1] = 1
    return np.cumprod(up, out=up), np.cumprod(down, out=down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the rolling multiplier and of its inverse, n at least."""
    return held_powers(next((k + (k >> 4) for k in (SMALL, CHUNK) if n <= k + (k >> 4)), 1 << (int(n) - 1).bit_length()))


def rolled(data: np.ndarray, values: np.ndarray = _BYTE_VALUE) -> np.ndarray:
    """Prefix sums of which differences, scaled, are hashes of byte ranges."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, U)
    out[1:] = values[data]
    out[1:] *= up[: len(data)]
    return np.cumsum(out, out=out)


def range_hash(prefix: np.ndarray, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
    """Hash of the bytes [start, end); equal ranges have equal hashes."""
    _, down = powers(len(prefix))
    out = prefix[end] - prefix[start]
    out *= down[start]
    return mix(out)


def words(data: np.ndarray, off: np.ndarray, separator: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the index of its first word (len + 1)."""
    inner = ~separator[data]
    n = len(data)
    first, last = inner.copy(), inner.copy()
    if n:
        first[1:] &= ~inner[:-1]
        last[:-1] &= ~inner[1:]
        edge = off[off < n]
        first[edge] = inner[edge]
        edge = off[(off > 0)] - 1
        last[edge] = inner[edge]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, off)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, A-Z as a-z."""
    return range_hash(rolled(data, _LOWER_VALUE), start, end) if len(start) else np.zeros(0, U)


def shingles(data: np.ndarray, off: np.ndarray, k: int = 5, separator: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles in order, each row's first index (len + 1), each row's words.

    A row with 1 to k - 1 words has its whole sequence as its one shingle; one without words has none.
    """
    start, end, at = words(data, off, separator)
    h, n = word_hashes(data, start, end), np.diff(at)
    full = np.zeros(max(0, len(h) - k + 1), U)
    for j in range(k):
        full = full * _STEP + h[j : j + len(full)]
    full = mix(full + U(k))
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    first = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(first[-1], U)
    row = np.repeat(np.arange(len(n)), count)
    take = at[:-1][row] + np.arange(first[-1]) - first[:-1][row]
    long = (n >= k)[row]
    out[long] = full[take[long]]
    for r in np.flatnonzero((n > 0) & (n < k)):
        x = np.zeros(1, U)
        for v in h[at[r] : at[r + 1]]:
            x = x * _STEP + v
        out[first[r]] = mix(x + U(n[r]))[0]
    return out, first, n
