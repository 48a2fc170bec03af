"""A cover tree over norm-augmented vectors and an exact best-first search by inner product.

A vector x of at most norm M becomes (x, sqrt(M^2 - |x|^2)), so that all candidates have norm M and
|q - x|^2 = |q|^2 + M^2 - 2 qx for every query (q, 0): close is the same as a large inner product.

The tree has levels: at level k the centres of a node's children lie more than 2^(k-1) apart and
every row goes to the first centre within 2^(k-1) of it. The covering radius that is stored is the
largest distance that really occurs; it decides the next level. By the triangle inequality the
distances of a node's rows to q are within this radius of the centre's, which bounds their inner
products from above and below; so does the plain ball |q| r around the centre's product.

A search has windows of allowed products. It takes the node of the largest upper bound first, skips
nodes that no window can use any more, and computes the products of a leaf's rows exactly.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

#: Rows of one tree; a forest has as many trees as it needs.
TREE_ROWS = 4_096
#: Nodes of at most so many rows are leaves.
LEAF_ROWS = 32
#: Leaves of at most so many rows are verified together with the node above them.
FEW_ROWS = 8
#: Pivots by which rows are sorted into trees, at most.
PIVOTS = 32
#: Stands for a missing id, which comes last among equals.
NO_ID = 2**63 - 1


def augmented(vectors: np.ndarray, norm: float) -> np.ndarray:
    """The vectors with the component that brings each to norm `norm`."""
    rest = np.maximum(norm * norm - np.einsum("ij,ij->i", vectors, vectors), 0.0)
    return np.column_stack([vectors, np.sqrt(rest)])


def neighbourhoods(points: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """`rows` in blocks of at most TREE_ROWS that lie close together."""
    done, todo = [], [rows]
    while todo:
        rows = todo.pop()
        if len(rows) <= TREE_ROWS:
            done.append(rows)
            continue
        mine = points[rows]
        squared = np.einsum("ij,ij->i", mine, mine)
        best, owner, pivot = np.full(len(rows), np.inf), np.zeros(len(rows), np.int64), 0
        pivots = min(PIVOTS, 2 * len(rows) // TREE_ROWS)
        for number in range(pivots):  # the farthest row from all pivots is the next one
            away = squared + squared[pivot] - 2.0 * (mine @ mine[pivot])
            closer = away < best
            best[closer], owner[closer] = away[closer], number
            pivot = int(best.argmax())
        parts = [part for part in (rows[owner == number] for number in range(pivots)) if len(part)]
        if max(map(len, parts)) > 0.9 * len(rows):  # equal rows or nearly so: any cut will do
            parts = [rows[first : first + TREE_ROWS] for first in range(0, len(rows), TREE_ROWS)]
        todo.extend(parts)
    return done


@dataclass
class Tree:
    """Nodes in preorder; node i has the tree's rows first[i] to last[i] and centre centre[i] among them."""

    first: list[int]
    last: list[int]
    centre: np.ndarray
    radius: np.ndarray
    children: dict[int, np.ndarray]
    order: np.ndarray


def grow(points: np.ndarray) -> Tree:
    """A cover tree over at least one point; `order` tells which point each of its rows is."""
    squared = np.einsum("ij,ij->i", points, points)
    near = np.maximum(squared[:, None] + squared[None, :] - 2.0 * points @ points.T, 0.0)

    def split(rows: np.ndarray, reach: float) -> list[np.ndarray]:
        """Groups around centres more than `reach` apart, the centre first."""
        free, groups = rows, []
        while len(free):
            mine = near[free[0], free] <= reach * reach
            mine[0] = True
            groups.append(free[mine])
            free = free[~mine]
        return groups

    first, last, centre, radius, order = [], [], [], [], []
    children: dict[int, list[int]] = {}
    stack = [(np.arange(len(points)), -1)]
    while stack:
        rows, parent = stack.pop()
        number, reach = len(first), float(np.sqrt(near[rows[0], rows].max()))
        if parent >= 0:
            children[parent].append(number)
        first.append(len(order))
        last.append(len(order) + len(rows))
        centre.append(len(order))
        radius.append(reach)
        if len(rows) <= LEAF_ROWS or reach < 0.5:  # whole numbers that differ are 1 apart
            order.extend(rows.tolist())
            continue
        children[number] = []
        level = math.ceil(math.log2(reach))
        stack.extend((group, number) for group in reversed(split(rows, 2.0 ** (level - 1))))
    # Squared distances are rounded; a little more radius keeps the bounds safe.
    safe = np.array(radius) * (1 + 1e-6) + 1e-3 + 1e-7 * math.sqrt(squared.max())
    return Tree(first, last, np.array(centre), safe, {k: np.array(v) for k, v in children.items()}, np.array(order))


class Best:
    """The k best rows met so far whose product lies from `low` to `high`.

    Larger products come first, ties by smaller id, then by smaller uid.
    """

    def __init__(self, k: int, low: float = -math.inf, high: float = math.inf):
        self.k, self.low, self.high = k, low, high
        self.found: list[tuple[int, int, int]] = []

    def floor(self) -> float:
        """What a row must reach to matter."""
        return max(self.low, self.found[-1][0]) if len(self.found) == self.k else self.low

    def take(self, products: np.ndarray, ids: np.ndarray, uids: np.ndarray) -> None:
        fit = np.flatnonzero((products >= self.floor()) & (products <= self.high))
        if len(fit) > 4 * self.k and products.dtype != object:
            fit = fit[np.lexsort((uids[fit], ids[fit], -products[fit]))[: self.k]]
        if len(fit):
            new = zip(map(int, products[fit]), ids[fit].tolist(), uids[fit].tolist())
            self.found = sorted([*self.found, *new], key=lambda x: (-x[0], x[1], x[2]))[: self.k]


class Forest:
    """Cover trees over whole-numbered vectors with ids, labels and uids that name rows."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, uids: np.ndarray, labels: np.ndarray):
        norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        self.norm = float(norms.max(initial=0.0)) * (1 + 1e-9)
        points = augmented(vectors, self.norm)
        blocks = neighbourhoods(points, np.arange(len(points))) if len(points) else []
        self.trees, orders, start = [], [], 0
        for block in blocks:
            tree = grow(points[block])
            self.trees.append((start, tree))
            orders.append(block[tree.order])
            start += len(block)
        order = np.concatenate(orders) if orders else np.zeros(0, np.int64)
        self.vectors, self.ids, self.uids, self.labels = vectors[order], ids[order], uids[order], labels[order]
        self.largest = float(np.abs(vectors).max(initial=0.0))
        self.roots = np.array([start + tree.centre[0] for start, tree in self.trees], np.int64)
        self.root_radii = np.array([tree.radius[0] for _, tree in self.trees])
        self.below = {
            (at, number): self._children(start, tree, children)
            for at, (start, tree) in enumerate(self.trees)
            for number, children in tree.children.items()
        }

    def _children(self, start: int, tree: Tree, children: np.ndarray) -> tuple:
        """What a node's visit needs in one piece: the rows of its small leaves with their labels,
        uids and ids, then the centres of its other children with their numbers and radii."""
        small = [c not in tree.children and tree.last[c] - tree.first[c] <= FEW_ROWS for c in children.tolist()]
        wide = children[~np.array(small)]
        spans = [np.arange(tree.first[c], tree.last[c]) for c, few in zip(children.tolist(), small) if few]
        rows = start + np.concatenate([*spans, np.zeros(0, np.int64)])
        vectors = self.vectors[np.concatenate([rows, start + tree.centre[wide]])]
        return vectors, (self.labels[rows], self.uids[rows], self.ids[rows]), wide.tolist(), tree.radius[wide]

    def products(self, vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Exact inner products: in double precision while all sums stay below 2^53."""
        if self.largest * float(np.abs(query).max(initial=0.0)) * max(1, len(query)) < 2.0**53:
            return vectors @ query
        whole = [int(x) for x in query]
        sums = [sum(int(a) * b for a, b in zip(row, whole)) for row in vectors]
        return np.array([*sums, None], object)[:-1]

    def bounds(self, products: np.ndarray, radius: np.ndarray, query: float) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest product within `radius` of centres; `query` is the query's norm."""
        both = query * query + self.norm * self.norm
        away = np.sqrt(np.maximum(both - 2.0 * products, 0.0))
        high = np.minimum(products + query * radius, (both - np.maximum(away - radius, 0.0) ** 2) / 2)
        low = np.maximum(products - query * radius, (both - (away + radius) ** 2) / 2)
        return low - 1e-9 * both - 1.0, high + 1e-9 * both + 1.0

    def search(
        self, query: np.ndarray, windows: list[Best], allowed: Callable[[np.ndarray, np.ndarray], np.ndarray]
    ) -> int:
        """Puts the rows with `allowed(labels, uids)` into `windows`; returns how many were multiplied."""
        if not windows or not self.trees:
            return 0
        norm = float(np.sqrt(query @ query))
        met = 0

        def least() -> float:
            return min(window.floor() for window in windows)

        def verify(products: np.ndarray, labels: np.ndarray, uids: np.ndarray, ids: np.ndarray) -> None:
            nonlocal met
            met += len(products)
            keep = np.flatnonzero(products >= least())
            keep = keep[allowed(labels[keep], uids[keep])]
            if len(keep):
                for window in windows:
                    window.take(products[keep], ids[keep], uids[keep])

        roots = self.products(self.vectors[self.roots], query).astype(float)
        lows, highs = self.bounds(roots, self.root_radii, norm)
        heap = [(-high, at, 0, low) for at, (low, high) in enumerate(zip(lows.tolist(), highs.tolist()))]
        heapq.heapify(heap)
        while heap:
            high, at, number, low = heapq.heappop(heap)
            if not any(window.floor() <= -high and low <= window.high for window in windows):
                continue
            inner = self.below.get((at, number))
            if inner is None:
                start, tree = self.trees[at]
                rows = slice(start + tree.first[number], start + tree.last[number])
                verify(self.products(self.vectors[rows], query), self.labels[rows], self.uids[rows], self.ids[rows])
                continue
            vectors, few, wide, radii = inner
            products = self.products(vectors, query)
            count = len(few[0])
            if count:
                verify(products[:count], *few)
            if wide:
                lows, highs = self.bounds(products[count:].astype(float), radii, norm)
                for k in np.flatnonzero(highs >= least()).tolist():
                    heapq.heappush(heap, (-float(highs[k]), at, wide[k], float(lows[k])))
        return met
