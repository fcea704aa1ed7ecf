"""Recursive graph bisection: documents that share terms come to lie side by side.

A set of documents is halved so that the logarithms of the gaps in the postings get small: each
round moves, from both halves, the documents that gain most by leaving, pair by pair. ``order`` does it
down to clusters; ``fit`` does it for a bounded sample and keeps, for every node, what each term says
about the side, so that ``route`` can send any other document down the same tree.
"""

from __future__ import annotations

import numpy as np

#: Rounds of moves in a node.
ROUNDS = 8


def _sides(left: np.ndarray, right: np.ndarray, n_left: float, n_right: float) -> np.ndarray:
    """By term: the cost that a document adds on the right less the one on the left; above 0 it belongs to the left."""
    cost = lambda n, degree: degree * np.log2(n / (degree + 1))
    return (cost(n_right + 1, right + 1) - cost(n_right + 1, right)) - (cost(n_left + 1, left + 1) - cost(n_left + 1, left))


def halves(doc: np.ndarray, term: np.ndarray, n: int, terms: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Whether each of n documents (postings doc, term) is on the right; the terms' weights; the median of the documents' sums."""
    right = np.arange(n) >= (n + 1) // 2
    weight = np.zeros(terms)
    for _ in range(ROUNDS):
        here = right[doc]
        count_right = np.bincount(term[here], minlength=terms).astype(float)
        count_left = np.bincount(term[~here], minlength=terms).astype(float)
        weight = _sides(count_left, count_right, float((~right).sum()), float(right.sum()))
        toward_left = np.bincount(doc, weight[term], n)
        a, b = np.flatnonzero(~right), np.flatnonzero(right)
        a, b = a[np.argsort(toward_left[a], kind="stable")], b[np.argsort(-toward_left[b], kind="stable")]
        m = min(len(a), len(b))
        swap = toward_left[b[:m]] - toward_left[a[:m]] > 1e-9
        if not swap.any():
            break
        right[a[:m][swap]], right[b[:m][swap]] = True, False
    return right, weight, float(np.median(np.bincount(doc, weight[term], n))) if n else 0.0


def _inside(doc: np.ndarray, term: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The postings of some documents, which are numbered anew."""
    number = np.full(n, -1)
    number[rows] = np.arange(len(rows))
    here = number[doc] >= 0
    return number[doc[here]], term[here]


def order(doc: np.ndarray, term: np.ndarray, n: int, least: int) -> np.ndarray:
    """The n documents in an order whose runs of least and fewer are the leaves. term: numbers from 0."""
    if n <= least:
        return np.arange(n)
    known, term = np.unique(term, return_inverse=True)
    right, _, _ = halves(doc, term, n, len(known))
    out = []
    for side in (~right, right):
        rows = np.flatnonzero(side)
        out.append(rows[order(*_inside(doc, term, rows, n), len(rows), least)])
    return np.concatenate(out)


def fit(doc: np.ndarray, term: np.ndarray, n: int, terms: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights (node, term) and bounds (node) of a tree of that depth, in heap order."""
    weights, bounds = np.zeros(((1 << depth) - 1, terms), np.float32), np.zeros((1 << depth) - 1)
    parts = {0: (doc, term, n)}
    for node in range((1 << depth) - 1):
        d, t, m = parts.pop(node, (doc[:0], term[:0], 0))
        if m < 2:
            continue
        right, weight, bounds[node] = halves(d, t, m, terms)
        weights[node] = weight
        for child, side in ((2 * node + 1, ~right), (2 * node + 2, right)):
            rows = np.flatnonzero(side)
            parts[child] = (*_inside(d, t, rows, m), len(rows))
    return weights, bounds


def route(weights: np.ndarray, bounds: np.ndarray, doc: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
    """The leaf (from 0) of each of n documents."""
    node = np.zeros(n, np.int64)
    for _ in range(len(bounds).bit_length()):
        total = np.bincount(doc, weights[node[doc], term], n)
        node = 2 * node + 1 + (total < bounds[node])
    return node - len(bounds)
