"""Nearest neighbours with pruning by bounding boxes: what a tree search does, for all queries together.

References lie in cells with a box each, and a tree of boxes (tessera.operators.boxes) lies over the cells. A query first
scans its nearest cells until it has k references, which bounds the distance of its k-th neighbour; then it descends the
tree to every further cell whose box is not farther than that bound. A box at exactly the bound is scanned, so that ties by
id come out right. Searches that may stop early go by budgets, or in rounds under a bound that tightens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.constants import K, Q
from tessera.operators import ivf, kernel
from tessera.operators.boxes import STRIP, Tree
from tessera.operators.knn import check_k
from tessera.operators.tiles import Counters, Tiles, as_tiles, blocks, of_probes, scan
from tessera.plans.storage import kept, kept_once

SAMPLE_ROWS = 20_000


def splits(references: DataFrame, cells: int, vector: Sequence[str] = tuple(Q), sample_rows: int = SAMPLE_ROWS) -> list[tuple[int, int, float, int, int]]:
    """A tree of (node, dimension, value, left, right) with at most so many leaves, from a bounded sample.

    A node is cut at the median of its widest dimension; leaves have right = -1. The sample is the sample_rows
    references with the smallest hash of their id: it shapes the cells, all references are put into them.
    """
    sample = references.orderBy(F.xxhash64("ref_id"), "ref_id").limit(sample_rows).select(*vector).toPandas().to_numpy(np.float64)
    tree: list[tuple[int, int, float, int, int]] = []
    todo = [(sample, 0)]
    while todo:
        todo.sort(key=lambda x: -len(x[0]))
        leaves = len(todo) + sum(t[3] == -1 for t in tree)
        part, node = todo.pop(0)
        wide = int((part.max(axis=0) - part.min(axis=0)).argmax()) if len(part) else 0
        value = float(np.median(part[:, wide])) if len(part) else 0.0
        low = part[:, wide] < value if len(part) else np.zeros(0, bool)
        if len(part) and not low.any():  # more than half have the least value
            value = float(part[:, wide].min()) + 0.5
            low = part[:, wide] < value
        if leaves >= cells or len(part) < 2 or not low.any() or low.all():
            tree.append((node, 0, 0.0, -1, -1))
            continue
        left = 1 + max([node, *(t[0] for t in tree), *(t[4] for t in tree), *(t[1] for t in todo)])
        tree.append((node, wide, value, left, left + 1))
        todo += [(part[low], left), (part[~low], left + 1)]
    return sorted(tree)


def assign(references: DataFrame, tree: list[tuple[int, int, float, int, int]], vector: Sequence[str] = tuple(Q)) -> DataFrame:
    """references with cell_id, the leaf that they fall into."""
    n = max(t[0] for t in tree) + 1
    dim, value, left, right = np.zeros(n, int), np.zeros(n), np.full(n, -1), np.full(n, -1)
    for node, d, v, a, b in tree:
        dim[node], value[node], left[node], right[node] = d, v, a, b

    @F.pandas_udf("bigint")
    def of(*columns: pd.Series) -> pd.Series:
        x = np.stack([s.to_numpy(np.float64) for s in columns], axis=1)
        node = np.zeros(len(x), int)
        while True:
            inner = left[node] >= 0
            if not inner.any():
                return pd.Series(node.astype(np.int64))
            at = node[inner]
            node[inner] = np.where(x[inner, dim[at]] < value[at], left[at], right[at])

    return references.withColumn("cell_id", of(*vector))


def boxes(assigned: DataFrame, vector: Sequence[str] = tuple(Q)) -> DataFrame:
    """(cell_id, n, lo_*, hi_*) of every cell."""
    edges = [f(v).alias(f"{p}_{v}") for v in vector for f, p in ((F.min, "lo"), (F.max, "hi"))]
    return assigned.groupBy("cell_id").agg(F.count("*").alias("n"), *edges)


class Boxes:
    """An index of cells that is opened once: its tiles, and the tree of the cells' boxes."""

    def __init__(self, tiles: Tiles, tree: Tree):
        self.tiles, self.tree = tiles, tree

    @property
    def count(self) -> int:
        return int(self.tree.n[0])


def opened(assigned: DataFrame | Boxes, vector: Sequence[str] = tuple(Q), heap: bool = False) -> Boxes:
    """Boxes of references with cell_id; with heap the cells are numbered as by tessera.operators.splits."""
    if isinstance(assigned, Boxes):
        return assigned
    assigned = kept_once(assigned)
    return Boxes(as_tiles(assigned, "cell_id", vector), Tree.of_boxes(boxes(assigned, vector), vector, heap))


def _columns(queries: DataFrame, vector: Sequence[str], query_id: str, more: Sequence[str]) -> DataFrame:
    return queries.select(F.col(query_id).cast("bigint").alias("qid"), *vector, *more)


def asks(queries: DataFrame, tree: Tree, choose: Callable, vector: Sequence[str] = tuple(Q), query_id: str = "qid", more: Sequence[str] = ()) -> DataFrame:
    """(qid, cluster_id, n, bound, rank, before) of the pairs that choose(matrix, arrays of more) -> (rows, leaves, bounds,
    ranks, before) picks: the same as tiles.blocks, as rows."""
    names = list(vector)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for s in range(0, len(f), STRIP):
                part = f.iloc[s : s + STRIP]
                rows, leaf, bound, rank, before = choose(part[names].to_numpy(np.float64), {m: part[m].to_numpy() for m in more})
                yield pd.DataFrame({"qid": part["qid"].to_numpy(np.int64)[rows], "cluster_id": tree.cell[leaf], "n": tree.n[leaf], "bound": bound.astype(np.int64), "rank": rank, "before": before})

    return _columns(queries, vector, query_id, more).mapInPandas(run, "qid bigint, cluster_id bigint, n bigint, bound bigint, rank bigint, before bigint")


def _asked(tree: Tree, choose: Callable) -> Callable:
    """choose as tiles.blocks wants it, with its counts."""

    def run(x: np.ndarray, more: dict) -> tuple:
        count: list = []
        rows, leaf, *_ = choose(x.astype(np.float64), more | {"count": count})
        return rows, tree.cell[leaf], None, None, (int(tree.n[leaf].sum()), sum(c[1] for c in count), sum(c[2] for c in count))

    return run


def _seeds(tree: Tree, k: int) -> Callable:
    """The nearest cells that hold the first k references."""
    return lambda x, more: tree.first(x, k)


def _rest(tree: Tree, k: int) -> Callable:
    """What else is not farther than tau, in the order of bound and cell; ranks go on from those of the seeds."""

    def choose(x: np.ndarray, more: dict) -> tuple:
        rows, leaf, bound = tree.within(x, more["tau"], more.get("count"))
        seeds = tree.first(x, k)
        size = len(tree.left)
        new = ~np.isin(rows * size + leaf, seeds[0] * size + seeds[1])
        rows, leaf, bound = rows[new], leaf[new], bound[new]
        order = np.lexsort((tree.cell[leaf], bound, rows))
        rows, leaf, bound = rows[order], leaf[order], bound[order]
        start = np.searchsorted(rows, np.arange(len(x)))
        rank = np.arange(len(rows)) - start[rows] + 1 + np.bincount(seeds[0], minlength=len(x))[rows]
        upto = np.r_[0, np.cumsum(tree.n[leaf])]
        return rows, leaf, bound, rank, upto[:-1] - upto[start[rows]] + np.bincount(seeds[0], weights=tree.n[seeds[1]], minlength=len(x)).astype(np.int64)[rows]

    return choose


def _scanned(index: Boxes, queries: DataFrame, choose: Callable, k: int, vector: Sequence[str], query_id: str, more: Sequence[str] = (), counters: Counters | None = None, known: DataFrame | None = None) -> DataFrame:
    return scan(index.tiles, blocks(queries, _asked(index.tree, choose), vector, query_id, more), len(vector), k, counters=counters, known=known)


def _tau(first: DataFrame, k: int, relax: float = 1.0) -> DataFrame:
    """(qid, tau): the distance of the k-th neighbour so far, or infinity where there are fewer."""
    full = F.when(F.count("*") >= k, F.max("d2")).otherwise(F.lit(float("inf")))
    return first.groupBy("qid").agg((full.cast("double") * relax).alias("tau"))


def _bounded(queries: DataFrame, tau: DataFrame, vector: Sequence[str], query_id: str) -> DataFrame:
    return _columns(queries, vector, query_id, ()).join(tau, "qid")


def search(queries: DataFrame, assigned: DataFrame | Boxes, k: int = K, vector: Sequence[str] = tuple(Q), query_id: str = "qid", visits: bool = False, relax: float = 1.0, counters: Counters | None = None) -> DataFrame:
    """(qid, ref_id, d2, fraud, rank), equal to the brute-force result; with visits instead (qid, cells, candidates).

    counters are told what is scanned and pruned. relax below 1 shrinks the bound beyond which cells are passed over: less work, and neighbours may be missed. k is 1 to 5.
    """
    check_k(k)
    index = opened(assigned, vector)
    first = kept(kernel.best(_scanned(index, queries, _seeds(index.tree, k), k, vector, query_id, (), counters), k))
    bounded = _bounded(queries, _tau(first, k, relax), vector, query_id)
    if visits:
        seed = asks(queries, index.tree, _seeds(index.tree, k), vector, query_id)
        rest = asks(bounded, index.tree, _rest(index.tree, k), vector, "qid", ("tau",))
        return seed.unionByName(rest).groupBy("qid").agg(F.count("*").alias("cells"), F.sum("n").alias("candidates"))
    more = _scanned(index, bounded, _rest(index.tree, k), k, vector, "qid", ("tau",), counters, first)
    return kernel.best(first.drop("rank").unionByName(more), k)


def descent(queries: DataFrame, assigned: DataFrame | Boxes, k: int = K, vector: Sequence[str] = tuple(Q), query_id: str = "qid") -> DataFrame:
    """(level, seen, pruned): of all queries' pairs with a node of the tree's level, how many were bounded, and how many of
    those lay beyond the query's k-th neighbour among its seeds. A pair is seen if its node's parent was not pruned."""
    index = opened(assigned, vector)
    tree = index.tree
    tau = _tau(kernel.best(_scanned(index, queries, _seeds(tree, k), k, vector, query_id), k), k)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for s in range(0, len(f), STRIP):
                part, count = f.iloc[s : s + STRIP], []
                tree.within(part[list(vector)].to_numpy(np.float64), part["tau"].to_numpy(), count)
                yield pd.DataFrame(count, columns=["level", "seen", "pruned"])

    return _bounded(queries, tau, vector, query_id).mapInPandas(run, "level int, seen bigint, pruned bigint").groupBy("level").agg(F.sum("seen").alias("seen"), F.sum("pruned").alias("pruned"))


def search_budget(queries: DataFrame, assigned: DataFrame | Boxes, budget: int | None = None, k: int = K, vector: Sequence[str] = tuple(Q), query_id: str = "qid", visits: int | None = None) -> DataFrame:
    """The k nearest within the `budget` nearest cells, or within those that hold the first `visits` references:
    best-first search that stops early."""
    if (budget is None) == (visits is None):
        raise ValueError("either a budget of cells or one of visits is wanted")
    check_k(k)
    index = opened(assigned, vector)
    tree = index.tree  # functions that go to workers must not hold the index's frame
    near = lambda x, more: tree.first(x, budget if visits is None else visits, visits is None)
    return kernel.best(_scanned(index, queries, near, k, vector, query_id), k)


def search_refined(queries: DataFrame, assigned: DataFrame | Boxes, visits: int, refine: tuple[int, int] = (2, 3), k: int = K, vector: Sequence[str] = tuple(Q), query_id: str = "qid") -> DataFrame:
    """search_budget, and the exact search for the queries whose fraud count lies in refine, next to the decision's border."""
    index = opened(assigned, vector)
    early = kept(search_budget(queries, index, None, k, vector, query_id, visits))
    border = kept(early.groupBy("qid").agg(F.sum("fraud").alias("f")).where(F.col("f").between(*refine)).select("qid"))
    again = search(queries.join(border.withColumnRenamed("qid", query_id), query_id, "left_semi"), index, k, vector, query_id)
    return early.join(border, "qid", "left_anti").unionByName(again)


def sweep(queries: DataFrame, assigned: DataFrame | Boxes, settings: Sequence[int], k: int = K, vector: Sequence[str] = tuple(Q), query_id: str = "qid", by_cells: bool = False) -> DataFrame:
    """(setting, qid, ref_id, d2, fraud, rank) for each budget of visits (or of cells), all from one scan: what is found in a
    cell counts for every budget that reaches the cell."""
    check_k(k)
    index, steps = opened(assigned, vector), sorted(set(settings))
    tree = index.tree

    def choose(x: np.ndarray, more: dict) -> tuple:
        rows, leaf, _, _, before = tree.first(x.astype(np.float64), steps[-1], by_cells)
        return rows, tree.cell[leaf], None, np.searchsorted(steps, before, side="right")

    return ivf.of_steps(scan(index.tiles, blocks(queries, choose, vector, query_id), len(vector), k, with_step=True), steps, k)


def spent(queries: DataFrame, assigned: DataFrame | Boxes, settings: Sequence[int], vector: Sequence[str] = tuple(Q), query_id: str = "qid") -> DataFrame:
    """(setting, qid, visits): the references that each budget of visits lets a query see; a cell is seen as a whole."""
    tree, steps = opened(assigned, vector).tree, sorted(set(settings))
    seen = asks(queries, tree, lambda x, more: tree.first(x, steps[-1]), vector, query_id)
    each = seen.withColumn("setting", F.explode(F.array(*map(F.lit, steps)))).where("before < setting")
    return each.groupBy("setting", "qid").agg(F.sum("n").alias("visits"))


def search_tuned(
    queries: DataFrame, assigned: DataFrame | Boxes, early_d2: int | None = None, epsilon: float = 0.0, soft: int = 1500, span: int = 1500, most_visits: int | None = None,
    k: int = K, vector: Sequence[str] = tuple(Q), query_id: str = "qid",
) -> tuple[DataFrame, DataFrame]:
    """The exact search in rounds, which may end early: (qid, ref_id, d2, fraud, rank) and (qid, rounds, cells, visits).

    Seeds are scanned first. A query whose k-th neighbour is then not farther than early_d2 is done. The others read their
    further cells in the order of bound and cell, 1, 2, 4, ... of them a round: those whose bound is not beyond the distance
    of the k-th neighbour so far, times 1 - epsilon * min(1, (visits - soft) / span) once a query has seen more than `soft`
    references. A query stops at the first cell beyond, or when it has seen most_visits. As cells are sorted and bounds
    only shrink, epsilon 0 without the other two is exact.
    """
    check_k(k)
    index = opened(assigned, vector)
    top = kept(kernel.best(_scanned(index, queries, _seeds(index.tree, k), k, vector, query_id), k))
    seeds = asks(queries, index.tree, _seeds(index.tree, k), vector, query_id).groupBy("qid").agg(F.count("*").alias("cells"), F.sum("n").alias("visits"))
    tau = _tau(top, k)
    ended = F.lit(False) if early_d2 is None else F.col("tau") <= early_d2
    state = kept(seeds.join(tau, "qid").select("qid", "tau", "cells", "visits", F.lit(0).alias("rounds"), ended.alias("done")))
    waiting = kept(asks(_bounded(queries, state.where(~F.col("done")).select("qid", "tau"), vector, query_id), index.tree, _rest(index.tree, k), vector, "qid", ("tau",)))
    start = waiting.groupBy("qid").agg(F.min("rank").alias("first"))
    waiting = kept(waiting.join(start, "qid").withColumn("place", F.col("rank") - F.col("first")).drop("first", "before"))  # from 0
    last = waiting.agg(F.max("place")).first()[0]
    step = 0
    while last is not None and (1 << step) - 1 <= last:
        scale = 1 - epsilon * F.least(F.greatest((F.col("visits") - soft) / F.lit(float(span)), F.lit(0.0)), F.lit(1.0))
        limit = F.lit(True) if most_visits is None else F.col("visits") < most_visits
        ready = state.where(~F.col("done") & limit).select("qid", "visits", (F.col("tau") * scale).alias("limit"))
        own = waiting.where(F.col("place").between((1 << step) - 1, (1 << (step + 1)) - 2))
        chosen = kept(own.join(ready, "qid").where(F.col("bound") <= F.col("limit")).select("qid", "cluster_id", "n"))
        more = scan(index.tiles, of_probes(queries, chosen, vector, query_id), len(vector), k, known=top)
        merged = kept(kernel.best(top.drop("rank").unionByName(more), k))
        read = chosen.groupBy("qid").agg(F.count("*").alias("new_cells"), F.sum("n").alias("new_visits"))
        # whoever read less than a whole round has met a cell beyond its bound, and all further ones lie beyond it, too
        after = state.drop("tau").join(read, "qid", "left").join(_tau(merged, k), "qid")
        state = kept(after.select(
            "qid", "tau", (F.col("cells") + F.coalesce("new_cells", F.lit(0))).alias("cells"), (F.col("visits") + F.coalesce("new_visits", F.lit(0))).alias("visits"),
            (F.col("rounds") + F.when(F.col("new_cells") > 0, 1).otherwise(0)).alias("rounds"), (F.coalesce("new_cells", F.lit(0)) < (1 << step)).alias("done"),
        ))
        top, step = merged, step + 1
        if state.where(~F.col("done")).isEmpty():
            break
    return top, state.select("qid", "rounds", "cells", "visits")
