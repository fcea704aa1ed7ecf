"""Terms of Arrow text columns, exactly: no term is told by a hash."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .textops import LOWER, NOT_ALNUM, column, words

#: Every ASCII byte that is no letter separates; all bytes of other characters belong to terms.
NOT_LETTER = np.array([i < 128 and not chr(i).isalpha() for i in range(256)])

__all__ = ["NOT_ALNUM", "NOT_LETTER", "coded", "terms"]


def terms(texts: pa.Array, separator: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All terms in order, A-Z as a-z, and the row that each is in."""
    data, off = column(texts)
    start, end, at = words(data, off, separator)
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=offsets[1:])
    flat = LOWER[data[~separator[data]]]
    found = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(flat))
    return found, np.repeat(np.arange(len(at) - 1), np.diff(at))


def coded(texts: pa.Array, separator: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The different terms; and for each pair of a row and a term in it: row, number of the term, occurrences."""
    found, row = terms(texts, separator)
    code = found.dictionary_encode()
    n = max(1, len(code.dictionary))
    pair, count = np.unique(row * n + code.indices.to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
    return code.dictionary, pair // n, pair % n, count
