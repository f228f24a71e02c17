"""Exact nearest entries of a codebook by a geometric near-neighbour access tree.

A node holds split points and the other entries dealt out to their nearest split point; for
each split point and each child it keeps the range of distances from that split point to the
child's entries (its own split point included).  A query's distance to a split point together
with the best distance so far rules out whole children by the triangle inequality.

Squared distances of whole numbers are whole numbers and are compared as such, ties to the
lower index.  Only what rules a child out is rounded: ranges are widened and the margin is
taken off, and a child goes only if its bound is *greater* than the best distance, so that
no entry at the same distance is lost.

Many queries walk the tree together: each child is visited with the queries that still
need it.
"""
from __future__ import annotations

import math

import numpy as np

ARITY = 8
LEAF = 8
#: Relative rounding that bounds have to take (square roots and sums of doubles err by far less).
_MARGIN = 2.0 ** -45
#: Squared distances below this are exact in doubles, and in sums of products of doubles.
EXACT = 1 << 52


def fits(*arrays: np.ndarray) -> bool:
    """Whether squared distances between rows of the arrays are exact in doubles."""
    if any(a.dtype == object for a in arrays):
        return False
    top = max((int(np.abs(a).max(initial=0)) for a in arrays), default=0)
    return 4 * top * top * max(a.shape[1] for a in arrays) < EXACT


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all rows of ``b``, exact: as doubles where those
    hold them, else as Python's whole numbers."""
    if a.dtype == object:
        return ((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2)
    return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)


def _root(d: np.ndarray) -> np.ndarray:
    """Distances; of numbers too large for doubles by way of their own size."""
    if d.dtype != object:
        return np.sqrt(d)
    return np.array([_big_root(int(x)) for x in d.ravel()], float).reshape(d.shape)


def _big_root(x: int) -> float:
    shift = max(0, x.bit_length() - 100) & ~1
    try:
        return math.ldexp(math.sqrt(float(x >> shift)), shift // 2)
    except OverflowError:
        return math.inf  # then no bound rules anything out


class Gnat:
    """A tree over the rows of ``entries`` (whole numbers)."""

    def __init__(self, entries: np.ndarray):
        self.whole = entries
        self.exact = fits(entries)
        self.entries = entries.astype(float) if self.exact else entries.astype(object)
        self.root = self._grown(np.arange(len(entries)))
        self.visited = 0

    def _grown(self, members: np.ndarray) -> tuple:
        if len(members) <= max(LEAF, ARITY):
            return ("leaf", members)
        splits = self._spread(members)
        rest = np.setdiff1d(members, splits)
        near = squared(self.entries[rest], self.entries[splits]).argmin(axis=1)
        children, low, high = [], [], []
        for j, split in enumerate(splits):
            mine = rest[near == j]
            d = _root(squared(self.entries[splits], self.entries[np.append(mine, split)]))
            low.append(d.min(axis=1))
            high.append(d.max(axis=1))
            children.append(self._grown(mine) if len(mine) else None)
        # from split point i to child j
        return ("node", splits, children, np.array(low).T * (1 - _MARGIN), np.array(high).T * (1 + _MARGIN))

    def _spread(self, members: np.ndarray) -> np.ndarray:
        """Split points far from each other, greedily."""
        chosen = [0]
        points = self.entries[members]
        away = squared(points, points[:1])[:, 0]
        while len(chosen) < ARITY:
            away[chosen] = -1
            chosen.append(int(away.argmax()))
            away = np.minimum(away, squared(points, points[chosen[-1:]])[:, 0])
        return members[np.array(chosen)]

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each query (the lowest of equally near ones) and its squared distance."""
        if self.exact and fits(queries, self.whole):
            queries, best = queries.astype(float), np.full(len(queries), np.inf)
            entries = self.entries
        else:
            queries, best = queries.astype(object), np.full(len(queries), None, object)
            entries = self.entries.astype(object) if not self.exact else self.whole.astype(object)
        index = np.full(len(queries), len(self.whole))
        self._walk(self.root, np.arange(len(queries)), queries, entries, best, index)
        return index, best

    def _take(self, at: np.ndarray, d: np.ndarray, names: np.ndarray, best: np.ndarray, index: np.ndarray) -> None:
        """Better or equally good entries with a lower index replace what the queries have."""
        for k in np.argsort(names):  # ascending: the first of equal ones stays
            now = best[at]
            better = np.array([b is None or x < b for x, b in zip(d[:, k], now, strict=True)], bool) if best.dtype == object else d[:, k] < now
            equal = ~better & (d[:, k] == now) & (names[k] < index[at])
            take = better | equal
            best[at[take]], index[at[take]] = d[take, k], names[k]

    def _walk(self, node: tuple, at: np.ndarray, queries: np.ndarray, entries: np.ndarray, best: np.ndarray, index: np.ndarray) -> None:
        if len(at) == 0:
            return
        names = node[1]
        d = squared(queries[at], entries[names])
        self.visited += d.size
        if best.dtype == object:
            self._take(at, d, names, best, index)
        else:  # the smallest distance, of equal ones the lowest index
            order = np.argsort(names)
            k = d[:, order].argmin(axis=1)
            found, name = d[np.arange(len(at)), order[k]], names[order[k]]
            now = best[at]
            take = (found < now) | ((found == now) & (name < index[at]))
            best[at[take]], index[at[take]] = found[take], name[take]
        if node[0] == "leaf":
            return
        _, _, children, low, high = node
        away = _root(d)
        slack = 1 - _MARGIN
        nearest = away.argmin(axis=1)
        done = np.zeros(away.shape, bool)
        for turn in (0, 1):  # first the child of the nearest split point, which brings the best distance down
            for j, child in enumerate(children):
                if child is None:
                    continue
                want = (nearest == j) if turn == 0 else ~done[:, j]
                if not want.any():
                    continue
                rows = np.flatnonzero(want)
                reach = _root(best[at[rows]]) * (1 + _MARGIN)
                with np.errstate(invalid="ignore"):  # inf - inf
                    bound = np.maximum(away[rows] * slack - high[:, j], low[:, j] - away[rows] * (1 + _MARGIN)).max(axis=1)
                rows = rows[~(bound > reach)]
                done[rows, j] = True
                self._walk(child, at[rows], queries, entries, best, index)
