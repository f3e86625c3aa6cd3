"""Nearest entries by a geometric near-neighbour access tree over integer points.

A node has split points; every other point of the node belongs to its nearest
split point, and for each pair (i, j) the node knows between which distances
from split point i the points of child j lie.  The distance from a query to
split point i then bounds its distance to all of child j from below, and a child
that lies wholly beyond the best distance so far is never entered.

Distances that decide between entries are squared integers.  Square roots only
exclude, with ranges rounded outwards and strictly, so that an entry of equal
distance is always reached and the lower index wins.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: outward rounding of square roots; far above the error of any step taken with them
SLACK = 1e-12
NOWHERE = np.iinfo(np.int64).max


def squared(points: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer ``points`` from ``point``."""
    apart = points - point
    return np.einsum("ij,ij->i", apart, apart)


@dataclass
class _Node:
    splits: np.ndarray
    low: np.ndarray
    high: np.ndarray
    children: list = field(default_factory=list)


class Gnat:
    """The tree over the rows of ``points``; ``fan`` split points a node."""

    def __init__(self, points: np.ndarray, fan: int = 16):
        self.points = np.asarray(points, np.int64)
        self.fan = fan
        self.root = self._build(np.arange(len(self.points)))

    def _build(self, members: np.ndarray) -> _Node:
        points = self.points[members]
        chosen, away = [0], [squared(points, points[0])]
        far = away[0].copy()
        while len(chosen) < min(self.fan, len(members)):
            far[chosen] = -1  # a point is one split point only, also among equal ones
            chosen.append(int(np.argmax(far)))
            away.append(squared(points, points[chosen[-1]]))
            far = np.minimum(far, away[-1])
        away = np.array(away)
        home = np.argmin(away, axis=0)
        home[chosen] = np.arange(len(chosen))
        roots = np.sqrt(away.astype(np.float64))
        low = np.array([[row[home == j].min() for j in range(len(chosen))] for row in roots]) * (1 - SLACK)
        high = np.array([[row[home == j].max() for j in range(len(chosen))] for row in roots]) * (1 + SLACK)
        rest = np.ones(len(members), bool)
        rest[chosen] = False
        node = _Node(members[chosen], low, high)
        for j in range(len(chosen)):
            inside = members[rest & (home == j)]
            node.children.append(self._build(inside) if len(inside) else None)
        return node

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distance and index of the nearest point of each query; of equal ones the lowest index."""
        queries = np.asarray(queries, np.int64)
        best = np.full(len(queries), NOWHERE)
        index = np.full(len(queries), NOWHERE)
        if len(queries):
            self._visit(self.root, queries, np.arange(len(queries)), best, index)
        return best, index

    def _visit(self, node: _Node, queries: np.ndarray, rows: np.ndarray, best: np.ndarray, index: np.ndarray) -> None:
        mine = queries[rows]
        least = np.zeros((len(rows), len(node.splits)))  # no point of child j is nearer than least[:, j]
        near = np.full(least.shape, np.inf)
        for i, number in enumerate(node.splits):
            on = np.flatnonzero(least[:, i] <= _reach(best[rows]))
            if not len(on):
                continue
            at = rows[on]
            away = squared(mine[on], self.points[number])
            better = (away < best[at]) | ((away == best[at]) & (number < index[at]))
            best[at[better]], index[at[better]] = away[better], number
            root = np.sqrt(away.astype(np.float64))
            near[on, i] = root
            above = (root * (1 - SLACK))[:, None] - node.high[i]
            below = node.low[i] - (root * (1 + SLACK))[:, None]
            least[on] = np.maximum(least[on], np.maximum(above, below))
        first = np.argmin(near, axis=1)
        for chosen in (True, False):  # the child of the nearest split point first, as it shortens the reach
            for j, child in enumerate(node.children):
                if child is None:
                    continue
                on = np.flatnonzero(((first == j) == chosen) & (least[:, j] <= _reach(best[rows])))
                if len(on):
                    self._visit(child, queries, rows[on], best, index)


def _reach(best: np.ndarray) -> np.ndarray:
    return np.sqrt(best.astype(np.float64)) * (1 + SLACK)
