"""Burkhard-Keller trees over 64-bit fingerprints, many at a time.

The children of a node are keyed by their whole-number Hamming distance to it, one child a
distance; whatever lies below a child has just that distance to the node.  A query at
distance d of a node follows only the edges from d - radius to d + radius.

A forest has a tree for each group.  All members of all trees go down together, a level at
a time, and so do all queries: a level is a few numpy operations on the pairs of
query and node that are still open, taken in blocks of bounded size.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from . import ragged

#: Pairs of query and node that are open at once.
BLOCK = 1 << 18


class Forest:
    """Trees over ``prints``, which are sorted by ``groups`` (0, 1, ...), distinct within a group."""

    def __init__(self, prints: np.ndarray, groups: np.ndarray):
        n = len(prints)
        self.prints = prints
        first = np.ones(n, bool)
        first[1:] = groups[1:] != groups[:-1]
        self.roots = np.flatnonzero(first)
        node, at = self.roots[np.cumsum(first) - 1] if n else np.zeros(0, np.int64), np.flatnonzero(~first)
        parents, edges, kids = [], [], []
        node = node[at]
        while len(at):
            # the first of those that go to the same edge of a node becomes its child there
            key = node * 65 + np.bitwise_count(prints[at] ^ prints[node])
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            new = np.ones(len(at), bool)
            new[1:] = sorted_key[1:] != sorted_key[:-1]
            child = at[order[new]]
            parents.append(sorted_key[new])
            kids.append(child)
            down = np.empty(len(at), np.int64)
            down[order] = child[np.cumsum(new) - 1]
            stay = down != at
            at, node = at[stay], down[stay]
        keys = np.concatenate(parents) if parents else np.zeros(0, np.int64)
        order = np.argsort(keys)
        #: 65 * parent + distance, ascending, and the child there.
        self.keys = keys[order]
        self.kids = (np.concatenate(kids) if kids else np.zeros(0, np.int64))[order]
        self.visited = 0

    def within(self, queries: np.ndarray, groups: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, member) of the same group at a distance up to ``radius``, block by block."""
        stack = [(np.arange(len(queries)), self.roots[groups])]
        while stack:
            query, node = stack.pop()
            if len(query) > BLOCK:
                stack.append((query[BLOCK:], node[BLOCK:]))
                query, node = query[:BLOCK], node[:BLOCK]
            d = np.bitwise_count(queries[query] ^ self.prints[node]).astype(np.int64)
            self.visited += len(d)
            near = d <= radius
            if near.any():
                yield query[near], node[near]
            low = np.searchsorted(self.keys, node * 65 + np.maximum(d - radius, 1), "left")
            many = np.searchsorted(self.keys, node * 65 + np.minimum(d + radius, 64), "right") - low
            if many.any():
                stack.append((np.repeat(query, many), self.kids[ragged.ranges(low, many)]))


def joined(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest number of the component of each of 0..n-1 under the links (a, b)."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            break
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label[label] != label).any():
            label = label[label]
    return label
