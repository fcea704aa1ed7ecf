"""A prefix tree of n-gram sets that finds all sets of high Jaccard similarity to many others at once.

Sets are sorted arrays of integers under one order for all, so that similar sets share paths from
the root. A node stands for a run of n-grams that all sets below it share. A walk goes down the tree
once for a block of queries: each carries the overlap counted so far, which it shares with all sets
below a node, and leaves a subtree as soon as the overlap plus what both sides have left after
the node's last n-gram cannot reach the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Similarity in hundredths.
PERCENT = 80
#: Cells of the table of a block of queries by n-grams of the tree.
CELLS = 8 << 20


class Trie:
    def __init__(self, sets: list[np.ndarray]) -> None:
        self.values = np.unique(np.concatenate(sets))
        self.sets = [np.searchsorted(self.values, s) for s in sets]
        keys = [s.astype(">u4").tobytes() for s in self.sets]
        order = sorted(range(len(sets)), key=keys.__getitem__)
        shared = np.zeros(len(order), np.int64)
        for i in range(1, len(order)):
            a, b = self.sets[order[i - 1]], self.sets[order[i]]
            n = min(len(a), len(b))
            differ = np.flatnonzero(a[:n] != b[:n])
            shared[i] = differ[0] if len(differ) else n
        #: A node: its run of n-grams, children, set (at a leaf, else -1), and the least and most size of the sets below it.
        self.run: list[np.ndarray] = []
        self.depth: list[int] = []
        self.children: list[list[int]] = []
        self.leaf: list[int] = []
        self.least: list[int] = []
        self.most: list[int] = []
        todo = [(0, len(order), 0, -1)]
        while todo:
            lo, hi, start, parent = todo.pop()
            first = self.sets[order[lo]]
            # Equal sets, and one that another begins with, end in leaves of empty runs.
            end = len(first) if hi - lo == 1 else min(len(first), int(shared[lo + 1 : hi].min()))
            node = len(self.run)
            sizes = [len(self.sets[order[i]]) for i in range(lo, hi)]
            self.run.append(first[start:end])
            self.depth.append(end)
            self.children.append([])
            self.leaf.append(order[lo] if hi - lo == 1 else -1)
            self.least.append(min(sizes))
            self.most.append(max(sizes))
            if parent >= 0:
                self.children[parent].append(node)
            if hi - lo > 1:
                cuts = [lo, *(i for i in range(lo + 1, hi) if shared[i] == end), hi]
                todo += [(a, b, end, node) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def similar(self, queries: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
        """(set, the queries whose similarity with it reaches the threshold), for sets that have any; nothing twice."""
        width = len(self.values)
        step = max(1, CELLS // max(1, width))
        for begin in range(0, len(queries), step):
            block = queries[begin : begin + step]
            held = np.zeros((width, len(block)), np.uint8)
            for i, q in enumerate(block):
                place = np.searchsorted(self.values, q)
                place[place == width] = 0
                held[place[self.values[place] == q], i] = 1
            passed = np.cumsum(held, axis=0, dtype=np.int32)  # n-grams of the query up to one of the tree's
            size = np.array([len(q) for q in block])
            in_tree = passed[-1] if width else np.zeros(len(block), np.int32)
            todo = [(0, np.arange(len(block)), np.zeros(len(block), np.int64))]
            while todo:
                node, alive, both = todo.pop()
                run, left = self.run[node], in_tree[alive]
                if len(run):
                    both = both + (held[run] if len(alive) == len(block) else held[run][:, alive]).sum(0, dtype=np.int64)
                    left = left - passed[run[-1], alive]
                if self.leaf[node] >= 0:
                    hit = (100 * both >= PERCENT * (size[alive] + self.most[node] - both)) & (both > 0)
                    if hit.any():
                        yield self.leaf[node], begin + alive[hit]
                    continue
                reach = both + np.minimum(left, self.most[node] - self.depth[node])
                keep = 100 * reach >= PERCENT * np.maximum(size[alive], self.least[node])
                if keep.any():
                    todo += [(c, alive[keep], both[keep]) for c in self.children[node]]


def links(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Links between sets of left and right (within left, if right is None) that connect whatever all of them would: a spanning forest.

    Sets are numbered left first.
    """
    if not left or right == []:
        return []
    trie, shift = Trie(right if right is not None else left), len(left) if right is not None else 0
    root, out = np.arange(len(left) + (len(right) if right is not None else 0)), []
    for i, found in trie.similar(left):
        group = root[found]
        own = root[shift + i]
        if (group == own).all():
            continue
        joined, first = np.unique(group, return_index=True)
        out += [(int(found[j]), shift + i) for r, j in zip(joined, first, strict=True) if r != own]
        root[np.isin(root, joined)] = own
    return out
