"""A tree of bounding boxes over the cells of an index, which a batch of queries descends together.

The tree has one leaf for each cell; its nodes are a table that is stored with the index and bounded by MOST_CELLS. A
batch of queries keeps one frontier, an array of (query, node) pairs: a step takes the pairs to their children, bounds the
distance to each child's box, and drops what lies beyond the query's bound. No matrix of queries and cells is ever made.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tessera.constants import Q

MOST_CELLS = 65_536
#: Queries of a batch whose frontier is held at a time.
STRIP = 1024


class Tree:
    """Nodes from the root (0) on, every node before its children: left (-1 in leaves) and right child, level, cell (of
    leaves), n references and n cells below, and the box."""

    def __init__(self, left, right, level, cell, n, low, high):
        self.left, self.right, self.level, self.cell = (np.asarray(x, np.int64) for x in (left, right, level, cell))
        self.n, self.low, self.high = np.asarray(n, np.int64), np.asarray(low, np.float64), np.asarray(high, np.float64)
        self.cells = np.where(self.left < 0, 1, 0)
        for i in range(len(self.left) - 1, -1, -1):
            if self.left[i] >= 0:
                self.cells[i] = self.cells[self.left[i]] + self.cells[self.right[i]]

    @classmethod
    def over(cls, cells: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray, heap: bool = False) -> Tree:
        """A tree over the cells: with heap, that of their numbers, where i has the children 2 i and 2 i + 1; else one that
        halves the cells by the centres of their boxes along the widest dimension, again and again."""
        cells, n = np.asarray(cells, np.int64), np.asarray(n, np.int64)
        if not len(cells):
            return cls([-1], [-1], [0], [-1], [0], np.full((1, low.shape[1]), np.inf), np.full((1, low.shape[1]), -np.inf))
        out: dict[str, list] = {x: [] for x in ("left", "right", "level", "cell", "n", "low", "high")}
        todo = [(np.arange(len(cells)), 0, -1, "left")]
        while todo:
            rows, level, parent, side = todo.pop(0)
            me = len(out["left"])
            if parent >= 0:
                out[side][parent] = me
            for name, x in (("left", -1), ("right", -1), ("level", level), ("cell", -1), ("n", n[rows].sum()), ("low", low[rows].min(axis=0)), ("high", high[rows].max(axis=0))):
                out[name].append(x)
            if len(rows) == 1:
                out["cell"][me] = cells[rows[0]]
                continue
            if heap:
                # the first number whose halves are told apart by these cells
                bits = np.array([int(c).bit_length() for c in cells[rows]])
                top = cells[rows] >> (bits - bits.min())
                while len(set(top.tolist())) > 1:
                    top = top >> 1
                depth = int(top[0]).bit_length()
                one = (cells[rows] >> (bits - depth - 1)) & 1
                a, b = rows[one == 0], rows[one == 1]
            else:
                middle = low[rows] + high[rows]
                order = rows[np.lexsort((cells[rows], middle[:, int((middle.max(axis=0) - middle.min(axis=0)).argmax())]))]
                a, b = order[: len(order) // 2], order[len(order) // 2 :]
            todo += [(a, level + 1, me, "left"), (b, level + 1, me, "right")]
        return cls(*(out[x] for x in ("left", "right", "level", "cell", "n", "low", "high")))

    @classmethod
    def of_boxes(cls, boxes: DataFrame, vector: Sequence[str] = tuple(Q), heap: bool = False) -> Tree:
        """Of a table (cell_id, n, lo_*, hi_*), which is bounded by MOST_CELLS."""
        t = boxes.orderBy("cell_id").limit(MOST_CELLS + 1).toPandas()
        if len(t) > MOST_CELLS:
            raise ValueError(f"more than {MOST_CELLS} cells")
        return cls.over(t["cell_id"].to_numpy(), t["n"].to_numpy(), *(t[[f"{p}_{v}" for v in vector]].to_numpy(np.float64) for p in ("lo", "hi")), heap)

    def table(self, spark: SparkSession, vector: Sequence[str] = tuple(Q)) -> DataFrame:
        """The nodes as a table, to be stored."""
        columns = {"node": np.arange(len(self.left)), "left": self.left, "right": self.right, "level": self.level, "cell_id": self.cell, "n": self.n}
        columns |= {f"{p}_{v}": x[:, j] for p, x in (("lo", self.low), ("hi", self.high)) for j, v in enumerate(vector)}
        return spark.createDataFrame(pd.DataFrame(columns))

    @classmethod
    def of_table(cls, nodes: DataFrame, vector: Sequence[str] = tuple(Q)) -> Tree:
        t = nodes.orderBy("node").limit(2 * MOST_CELLS + 1).toPandas()
        if not len(t) or len(t) > 2 * MOST_CELLS or (t["node"].to_numpy() != np.arange(len(t))).any():
            raise ValueError("the index has no whole tree of boxes")
        return cls(*(t[x].to_numpy() for x in ("left", "right", "level", "cell_id", "n")), *(t[[f"{p}_{v}" for v in vector]].to_numpy() for p in ("lo", "hi")))

    def bounds(self, x: np.ndarray, rows: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """The least squared distance of each pair's query from any point of its node's box."""
        total = np.zeros(len(rows))
        for d in range(x.shape[1]):
            q = x[rows, d]
            out = np.maximum(np.maximum(self.low[nodes, d] - q, q - self.high[nodes, d]), 0)
            total += out * out
        return total

    def _children(self, x: np.ndarray, rows: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r, c = np.repeat(rows, 2), np.stack([self.left[nodes], self.right[nodes]], axis=1).ravel()
        return r, c, self.bounds(x, r, c)

    def within(self, x: np.ndarray, tau: np.ndarray, count: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows of x, leaves, bounds) of all leaves that are not farther than tau. count is given (level, seen, dropped) of
        each step."""
        rows, nodes = np.arange(len(x)), np.zeros(len(x), np.int64)
        near = self.bounds(x, rows, nodes)
        out = []
        level = 0
        while True:
            keep = near <= tau[rows]
            if count is not None:
                count.append((level, len(rows), int(len(rows) - keep.sum())))
            rows, nodes, near = rows[keep], nodes[keep], near[keep]
            leaf = self.left[nodes] < 0
            out.append((rows[leaf], nodes[leaf], near[leaf]))
            rows, nodes = rows[~leaf], nodes[~leaf]
            if not len(rows):
                return tuple(np.concatenate(c) for c in zip(*out, strict=True))
            rows, nodes, near = self._children(x, rows, nodes)
            level += 1

    def first(self, x: np.ndarray, budget: int, by_cells: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(rows, leaves, bounds, rank from 1, references or cells before) of the nearest leaves of each query, by bound and
        cell, until they hold `budget` references (or are so many): best-first search for the whole batch.

        A frontier is sorted; of the nodes that it takes to fill the budget, the inner ones are replaced by their children,
        until all of them are leaves. Inner nodes go before leaves of the same bound, as a leaf below may tie with those.
        """
        weight = self.cells if by_cells else self.n
        rows, nodes = np.arange(len(x)), np.zeros(len(x), np.int64)
        near = self.bounds(x, rows, nodes)
        done = []
        while len(rows):
            leaf = self.left[nodes] < 0
            order = np.lexsort((np.where(leaf, self.cell[nodes], -1), leaf, near, rows))
            rows, nodes, near, leaf = rows[order], nodes[order], near[order], leaf[order]
            start = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            sizes = np.diff(np.r_[start, len(rows)])
            total = np.cumsum(weight[nodes])
            before = total - weight[nodes]
            before -= np.repeat(before[start], sizes)
            needed = before < budget
            open_ = needed & ~leaf
            unsettled = np.zeros(len(x), bool)
            unsettled[rows[open_]] = True
            ready = ~unsettled[rows] & needed
            rank = np.arange(len(rows)) - np.repeat(start, sizes) + 1
            done.append((rows[ready], nodes[ready], near[ready], rank[ready], before[ready]))
            stay = unsettled[rows] & ~open_
            # what is not needed now can be needed later, when children turn out to be farther than their parent
            r, c, b = self._children(x, rows[open_], nodes[open_])
            rows, nodes, near = np.r_[rows[stay], r], np.r_[nodes[stay], c], np.r_[near[stay], b]
        return tuple(np.concatenate(c) for c in zip(*done, strict=True)) if done else tuple(np.zeros(0, np.int64) for _ in range(5))
