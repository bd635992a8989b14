"""Searches in groups that are divided into parts, against the plain scan and a plain computation."""

from __future__ import annotations

import numpy as np
import pytest

from tessera.operators import cells, ivf, knn, parts
from tessera.operators.tiles import as_tiles
from tessera.operators.topk import nearest_of
from tessera.plans import index
from tessera.plans.storage import kept

from .test_search import brute, table, told


@pytest.fixture(scope="module")
def sides(spark):
    """Half of the references on a coarse grid where distances tie, and some that are all equal."""
    rng = np.random.default_rng(8)
    r = np.r_[rng.integers(-10000, 10001, (1200, 14)), rng.integers(0, 2, (1000, 14)) * 10000, np.full((600, 14), 77)]
    q = np.r_[rng.integers(-10000, 10001, (150, 14)), rng.integers(0, 2, (150, 14)) * 10000, np.full((20, 14), 77)]
    return q, r, kept(table(spark, q, "qid")), kept(table(spark, r, "ref_id", rng.integers(0, 2, len(r))))


@pytest.fixture
def divided(monkeypatch):
    monkeypatch.setattr(parts, "MOST_PAIRS", 0)
    monkeypatch.setattr(parts, "PART_ROWS", 400)
    monkeypatch.setattr(parts, "SALT_ROWS", 100)


def rows(found):
    return sorted(map(tuple, found.collect()))


def test_brute(sides, divided):
    q, r, queries, references = sides
    for k in (1, 5):
        found = knn.knn(queries, references, k)
        assert "CartesianProduct" not in (plan := found._jdf.queryExecution().toString()) and "NestedLoop" not in plan
        assert told(found, len(q)) == brute(q, r, k)
    assert told(knn.knn(queries, kept(knn.packed(references))), len(q)) == brute(q, r, 5)


def test_few_and_none(spark, divided):
    rng = np.random.default_rng(3)
    q, r = rng.integers(-100, 100, (4, 14)), rng.integers(-100, 100, (3, 14))
    assert told(knn.knn(table(spark, q, "qid"), table(spark, r, "ref_id")), 4) == brute(q, r, 5)
    assert knn.knn(table(spark, q, "qid"), table(spark, r, "ref_id").where("false")).count() == 0


def test_groups(sides, monkeypatch):
    """Every search that scans groups gives the same rows where these are divided."""
    q, r, queries, references = sides
    centroids, assigned = index.build_ivf(references, clusters=7, rounds=2)
    assigned, levels = as_tiles(kept(assigned)), index.build_levels(references, 3)
    opened = cells.opened(levels, heap=True)

    def run():
        found, spent = cells.search_tuned(queries, opened)
        return [
            ivf.search(queries, centroids, assigned, base=1, most=4), ivf.sweep(queries, centroids, assigned, (1, 2, 5)), cells.search(queries, opened),
            cells.search_budget(queries, opened, 2), cells.sweep(queries, opened, (400, 900, 2000)), cells.descent(queries, opened), found, spent,
        ]

    want = [rows(f) for f in run()]
    monkeypatch.setattr(parts, "MOST_PAIRS", 0)
    monkeypatch.setattr(parts, "PART_ROWS", 120)
    got = [rows(f) for f in run()]
    assert [a == b for a, b in zip(got, want, strict=True)] == [True] * len(want)


def test_leaves_prune():
    """A part's search computes distances to few of its rows, and finds what all of them give."""
    rng = np.random.default_rng(5)
    r = rng.integers(0, 10001, (20_000, 3)).astype(np.int32)
    r = r[parts.by_leaves(r)]
    q = rng.integers(0, 10001, (500, 3)).astype(np.int32)
    ids = rng.permutation(len(r))
    i, j, d = parts.nearest(q, np.full(len(q), np.inf), r, ids, 5)
    full = ((q[:, None].astype(np.int64) - r[None]) ** 2).sum(axis=2)
    assert [(a, ids[b], c) for a, b, c in zip(i, j, d, strict=True)] == [(a, ids[b], full[a, b]) for a in range(len(q)) for b in np.lexsort((ids, full[a]))[:5]]
    starts = parts.ranges(len(r))
    low, high = np.minimum.reduceat(r, starts), np.maximum.reduceat(r, starts)
    near = parts.bounds(q, low.astype(float), high.astype(float))
    assert (near <= full.min(axis=1)[:, None]).mean() < 0.1
    exact = np.minimum.reduceat(full, starts, axis=1)
    assert (near <= exact).all()


def test_sets_of_groups():
    """A query finds only rows of the groups that it asks, also where a leaf holds rows of several."""
    rng = np.random.default_rng(6)
    r = rng.integers(0, 300, (1500, 4)).astype(np.int32)
    r = r[parts.by_leaves(r)]
    q, ids, own = rng.integers(0, 300, (200, 4)).astype(np.int32), rng.permutation(len(r)), rng.integers(0, 5, len(r)).astype(np.uint8)
    asked = rng.integers(0, 32, len(q))
    full = ((q[:, None].astype(np.int64) - r[None]) ** 2).sum(axis=2)
    for tau in (np.inf, 900.0):
        i, j, d = parts.nearest(q, np.full(len(q), tau), r, ids, 5, asked, own)
        want = []
        for a in range(len(q)):
            may = np.flatnonzero((asked[a] >> own.astype(np.int64)) & 1 & (full[a] <= tau))
            want += [(a, ids[b], full[a, b]) for b in may[np.lexsort((ids[may], full[a, may]))][:5]]
        assert [(a, ids[b], c) for a, b, c in zip(i, j, d, strict=True)] == want


def test_groups_together(sides, monkeypatch):
    """Clusters are divided together, a part holds rows of several, and queries that meet many parts go on by rank."""
    q, r, queries, references = sides
    centroids, assigned = index.build_ivf(references, clusters=7, rounds=1)
    assigned = as_tiles(kept(assigned))
    want = rows(ivf.search(queries, centroids, assigned, base=3, most=3))
    for name, value in {"MOST_PAIRS": 0, "PART_ROWS": 120, "WIDE": 2, "NEXT": 3}.items():
        monkeypatch.setattr(parts, name, value)
    assert rows(ivf.search(queries, centroids, assigned, base=3, most=3)) == want
    divided = assigned.parts(14, together=True)
    assert sum(divided.n) == len(r)
    assert any(bin(h).count("1") > 1 for h in divided.has.tolist())


def test_loose_bound(monkeypatch):
    """Where tau is loose, rows that wait for exact distances are bounded, and those of groups that aren't asked never wait."""
    rng = np.random.default_rng(9)
    r = rng.integers(0, 300, (3000, 4)).astype(np.int32)
    r = r[parts.by_leaves(r)]
    q, ids, own = rng.integers(0, 300, (100, 4)).astype(np.int32), rng.permutation(len(r)), rng.integers(0, 5, len(r)).astype(np.uint8)
    asked = np.int64(1) << rng.integers(0, 5, len(q))
    full = ((q[:, None].astype(np.int64) - r[None]) ** 2).sum(axis=2)
    seen = []
    monkeypatch.setattr(parts, "HITS", 500, raising=False)
    monkeypatch.setattr(parts, "nearest_of", lambda order, keys, k: (seen.append(len(keys[0])), nearest_of(order, keys, k))[1])
    for sets in (None, asked):
        for tau in (np.inf, 1e6):
            i, j, d = parts.nearest(q, np.full(len(q), tau), r, ids, 5, sets, None if sets is None else own)
            want = []
            for a in range(len(q)):
                may = np.arange(len(r)) if sets is None else np.flatnonzero((asked[a] >> own.astype(np.int64)) & 1)
                want += [(a, ids[b], full[a, b]) for b in may[np.lexsort((ids[may], full[a, may]))][:5]]
            assert [(a, ids[b], c) for a, b, c in zip(i, j, d, strict=True)] == want
    # what waits, and the k nearest so far
    assert max(seen) <= 500 + 5 * len(q)
