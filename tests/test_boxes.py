"""Order statistics, splits, trees of boxes and what is searched with them, against plain computations."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tessera.operators import splits
from tessera.operators.boxes import Tree
from tessera.operators.selection import nth
from tessera.plans.storage import kept

from .test_search import table


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(7)
    r = rng.integers(-10000, 10001, (500, 14))
    r[:, 9:12] = rng.integers(0, 2, (500, 3)) * 10000  # flags
    r[100:220] = r[100]  # one spot holds a quarter of all
    return r, kept(table(spark, r, "ref_id", rng.integers(0, 2, 500)))


def test_nth(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, 300), rng.normal(0, 1, 40) * 1e300, [0.0, -0.0] * 30, [1e-320, -1e-320, 1.7e308, -1.7e308], [math.inf, -math.inf]])
    rows = spark.createDataFrame([(int(i % 3), float(v)) for i, v in enumerate(x)] + [(0, None)], "g int, value double")
    sides = {g: np.sort(x[np.arange(len(x)) % 3 == g]) for g in range(3)}
    wanted = [(g, at) for g in range(3) for at in (0, 1, 5, 60, len(sides[g]) // 2, len(sides[g]) - 1, len(sides[g]), -1)]
    got = {(r.g, r.at): (r.value, r.rest) for r in nth(rows, spark.createDataFrame(wanted, "g int, at bigint"), ["g"]).collect()}
    assert got == {(g, at): (sides[g][at], at - int((sides[g] < sides[g][at]).sum())) for g, at in wanted if 0 <= at < len(sides[g])}
    nan = spark.createDataFrame([(0, v) for v in (math.nan, 1.0, math.nan, math.nan)], "g int, value double")
    last = nth(nan, spark.createDataFrame([(0, 0), (0, 3)], "g int, at bigint"), ["g"]).orderBy("at").collect()
    assert last[0].value == 1.0 and math.isnan(last[1].value) and last[1].rest == 2
    big = spark.createDataFrame([(0, 2**62 + i) for i in range(5)], "g int, value bigint")
    assert [r.value for r in nth(big, spark.createDataFrame([(0, 3)], "g int, at bigint"), ["g"]).collect()] == [2**62 + 3]


def plain_split(x, depth, rule, least):
    cells = np.ones(len(x), int)
    for level in range(depth):
        for c in set(cells.tolist()):
            rows = np.flatnonzero(cells == c)
            if len(rows) <= max(1, least) or c < 2**level:
                continue
            part = x[rows]
            d = int((part.max(axis=0) - part.min(axis=0)).argmax())
            order = rows[np.lexsort((rows, part[:, d]))]
            n, m = len(rows), len(rows) // 2
            if rule == "midpoint" and n > 2 and part[:, d].max() > part[:, d].min():
                side = max(1, n // 9)
                m = min(max(int((2 * part[:, d] < part[:, d].max() + part[:, d].min()).sum()), side), n - side)
            cells[order[:m]], cells[order[m:]] = 2 * c, 2 * c + 1
    return cells


@pytest.mark.parametrize("rule,depth,least", [("median", 4, 1), ("midpoint", 3, 1), ("median", 3, 130)])
def test_splits(spark, points, rule, depth, least):
    x, references = points
    got = splits.split(references, depth, rule, least)
    cells = np.zeros(len(x), int)
    for r in got.collect():
        cells[r.ref_id] = r.cell_id
    sizes = np.bincount(cells)
    if least == 1:
        assert (cells == plain_split(x, depth, rule, least)).all()
        assert (sizes[sizes > 0].max() <= math.ceil(500 / 2**depth)) if rule == "median" else True
    if rule == "midpoint":
        # no split gives less than a ninth to a side
        for level in range(depth):
            for node in range(2**level, 2 ** (level + 1)):
                below = [int((cells >> (depth - level - 1) == child).sum()) for child in (2 * node, 2 * node + 1)]
                assert min(below) >= max(1, sum(below) // 9)


def test_splits_count_each_value_in_one_pass(spark, points, monkeypatch):
    """Nodes of few values need no rounds over ranges, for values or ids; wide ones do, with the same cells."""
    x, references = points
    rounds = []
    monkeypatch.setattr(splits, "nth", lambda *a, whole=splits.nth: rounds.append(1) or whole(*a))
    by_count = {r.ref_id: r.cell_id for r in splits.split(references, 2, "midpoint").collect()}
    assert not rounds
    monkeypatch.setattr(splits, "MOST_VALUES", 2)
    assert {r.ref_id: r.cell_id for r in splits.split(references, 2, "midpoint").collect()} == by_count and rounds


def test_tree_of_boxes(spark):
    rng = np.random.default_rng(1)
    m = 37
    low = rng.integers(0, 50, (m, 3)).astype(float)
    high, n, ids = low + rng.integers(0, 20, (m, 3)), rng.integers(1, 9, m), np.arange(100, 100 + m)
    tree = Tree.over(ids, n, low, high)
    again = Tree.of_table(tree.table(spark, ["a", "b", "c"]), ["a", "b", "c"])
    x = rng.integers(-10, 90, (50, 3)).astype(float)
    x[::5] = x[0]
    near = sum(np.maximum(np.maximum(low[None, :, d] - x[:, d, None], x[:, d, None] - high[None, :, d]), 0) ** 2 for d in range(3))
    for t in (tree, again):
        for budget, by in ((5, False), (1, False), (60, False), (10**6, False), (7, True)):
            rows, leaf, bound, rank, before = t.first(x, budget, by)
            got = sorted(zip(rows.tolist(), rank.tolist(), t.cell[leaf].tolist(), before.tolist(), bound.tolist(), strict=True))
            want = []
            for i in range(50):
                order = np.lexsort((ids, near[i]))
                weight = np.ones(m, int) if by else n
                upto = np.cumsum(weight[order]) - weight[order]
                want += [(i, j + 1, int(ids[order[j]]), int(upto[j]), near[i, order[j]]) for j in range(m) if upto[j] < budget]
            assert got == want
        tau = rng.integers(0, 900, 50).astype(float)
        seen: list = []
        rows, leaf, bound = t.within(x, tau, seen)
        assert sorted(zip(rows.tolist(), t.cell[leaf].tolist(), strict=True)) == sorted((i, int(ids[j])) for i in range(50) for j in range(m) if near[i, j] <= tau[i])
        assert sum(s[1] for s in seen) < 50 * (2 * m - 1)  # fewer pairs than all
    heap = Tree.over(np.array([4, 5, 6, 14, 15]), np.ones(5, int), low[:5], high[:5], heap=True)
    assert heap.cell.tolist() == [-1, -1, -1, 4, 5, 6, -1, 14, 15] and heap.left.tolist() == [1, 3, 5, -1, -1, -1, 7, -1, -1]
    none = Tree.over(np.zeros(0, int), np.zeros(0, int), np.zeros((0, 3)), np.zeros((0, 3)))
    assert len(none.within(x, np.full(50, 1e9))[0]) == 0
    with pytest.raises(ValueError):
        Tree.of_table(tree.table(spark, ["a", "b", "c"]).where("node <> 1"), ["a", "b", "c"])
