"""Searches against a plain computation in NumPy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.constants import Q
from tessera.operators import cells, ivf, knn, tiles
from tessera.operators.vote import bucket, vote
from tessera.plans import index, scorers
from tessera.plans.storage import kept, shared_dir
from tessera.sources import requests as S


def table(spark, x, id_col, fraud=None):
    fraud = np.zeros(len(x), int) if fraud is None else fraud
    rows = [(i, *map(int, v), int(f)) for i, (v, f) in enumerate(zip(x, fraud, strict=True))]
    return spark.createDataFrame(rows, ", ".join([f"{id_col} bigint", *(f"{q} int" for q in Q), "fraud int"]))


def brute(q, r, k):
    d = ((q[:, None, :].astype(np.int64) - r[None].astype(np.int64)) ** 2).sum(axis=2)
    return [[(int(j), int(row[j])) for j in np.lexsort((np.arange(len(r)), row))[:k]] for row in d]


def told(found, n):
    out = [[] for _ in range(n)]
    for r in found.orderBy("qid", "rank").collect():
        out[r.qid].append((r.ref_id, r.d2))
    return out


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(42)
    centres = rng.integers(-10000, 10001, (12, 14))
    r = np.clip(centres[rng.integers(0, 12, 900)] + rng.normal(0, 300, (900, 14)).astype(int), -10000, 10000)
    r[5:60] = r[4]  # ties
    q = np.clip(np.r_[r[rng.integers(0, 900, 40)], rng.integers(-10000, 10001, (20, 14))], -10000, 10000)
    fraud = rng.integers(0, 2, 900)
    return q, r, kept(table(spark, q, "qid")), kept(table(spark, r, "ref_id", fraud))


@pytest.mark.parametrize("n", [1, 2, 3, 7, 15])
def test_few_references(spark, n):
    rng = np.random.default_rng(n)
    q, r = rng.integers(-100, 100, (4, 14)), rng.integers(-100, 100, (n, 14))
    found = knn.knn(table(spark, q, "qid"), table(spark, r, "ref_id"))
    assert told(found, 4) == brute(q, r, 5)


def test_brute_forms_agree(spark, blobs):
    q, r, queries, references = blobs
    want = brute(q, r, 5)
    assert told(knn.knn(queries, references), len(q)) == want
    assert told(knn.knn(queries, references, broadcast_bytes=0), len(q)) == want
    assert told(knn.knn_relational(queries, references), len(q)) == want


def test_k_is_checked():
    assert knn.check_k(5) == 5
    with pytest.raises(ValueError):
        knn.check_k(6)


def test_small_tiles(spark, blobs, monkeypatch):
    q, r, queries, references = blobs
    monkeypatch.setattr(knn, "QUERY_ROWS", 7)
    monkeypatch.setattr(knn, "REFERENCE_ROWS", 50)
    assert told(knn.knn(queries, references), len(q)) == brute(q, r, 5)


def test_ivf(spark, blobs):
    q, r, queries, references = blobs
    centroids, assigned = index.build_ivf(references, clusters=9, rounds=3)
    assigned = kept(assigned)
    want = brute(q, r, 5)
    assert told(ivf.search(queries, centroids, assigned, base=9, most=9), len(q)) == want
    one = told(ivf.search(queries, centroids, assigned, base=1, most=1), len(q))
    assert np.mean([a == b for a, b in zip(one, want, strict=True)]) > 0.5
    # refinement is the wider search for the queries whose vote is near the border, if no cap binds
    adaptive = told(ivf.search(queries, centroids, assigned, base=1, most=4, refine=(0, 5)), len(q))
    assert adaptive == told(ivf.search(queries, centroids, assigned, base=4, most=4), len(q))
    assert told(ivf.search(queries, centroids, assigned, base=1, most=4, refine=(9, 9)), len(q)) == one
    assert all(len(x) <= 3 for x in told(ivf.search(queries, centroids, assigned, base=4, most=4, cap=3), len(q)))
    assert told(ivf.search(queries, centroids, assigned, base=9, most=9, cap=900), len(q)) == want
    sizes = ivf.cluster_sizes(assigned, centroids)
    assert sizes.agg(F.sum("n")).first()[0] == 900 and sizes.count() == 9


def test_cells(spark, blobs):
    q, r, queries, references = blobs
    assigned = kept(index.build_cells(references, 40))
    assert 20 <= assigned.select("cell_id").distinct().count() <= 40
    assert told(cells.search(queries, assigned), len(q)) == brute(q, r, 5)
    seen = cells.search(queries, assigned, visits=True)
    assert seen.agg(F.min("candidates")).first()[0] >= 5 and seen.agg(F.avg("candidates")).first()[0] < 900
    assert told(cells.search_budget(queries, assigned, 10**6), len(q)) == brute(q, r, 5)
    assert told(cells.search_budget(queries, assigned, visits=900), len(q)) == brute(q, r, 5)
    assert told(cells.search_refined(queries, assigned, 50, (0, 5)), len(q)) == brute(q, r, 5)
    one = told(cells.search_budget(queries, assigned, visits=5), len(q))
    assert told(cells.search_refined(queries, assigned, 5, (9, 9)), len(q)) == one
    assert told(cells.search(queries, assigned, relax=1e9), len(q)) == brute(q, r, 5)
    less = told(cells.search(queries, assigned, relax=0.0), len(q))
    assert all(x[1] >= y[1] for a, b in zip(less, brute(q, r, 5), strict=True) for x, y in zip(a, b, strict=True))
    with pytest.raises(ValueError):
        cells.search_budget(queries, assigned)
    few = kept(index.build_cells(table(spark, r[:3], "ref_id"), 8))
    assert told(cells.search(queries, few), len(q)) == brute(q, r[:3], 5)


def test_many_queries_with_ties(spark):
    """2000 queries against 2000 references, half of them on a coarse grid where distances tie."""
    rng = np.random.default_rng(8)
    r = np.r_[rng.integers(-10000, 10001, (1000, 14)), rng.integers(0, 2, (1000, 14)) * 10000]
    q = np.r_[rng.integers(-10000, 10001, (1000, 14)), rng.integers(0, 2, (1000, 14)) * 10000]
    queries, references = kept(table(spark, q, "qid")), kept(table(spark, r, "ref_id"))
    want = []
    for part in np.array_split(q, 20):
        want += brute(part, r, 5)
    assert told(knn.knn(queries, references), len(q)) == want
    assert told(cells.search(queries, index.build_levels(references, 5, "midpoint")), len(q)) == want
    centroids, assigned = index.build_ivf(references, clusters=12, rounds=1)
    assert told(ivf.search(queries, centroids, assigned, 12, 12), len(q)) == want


def test_votes(spark):
    found = spark.createDataFrame([(0, 1), (0, 1), (0, 1), (0, 0), (0, 0), (1, 1), (1, 0)], "qid bigint, fraud int")
    got = {r.qid: (r.frauds, r.fraud_score, r.approved) for r in vote(found, 100).collect()}
    assert got == {0: (3, 0.6, False), 1: (1, 0.2, True)}
    # fewer references than five: the score is of what there is, and half goes up in a response
    assert vote(found.where("qid = 1"), 2).first().fraud_score == 0.5
    assert [r[0] for r in spark.createDataFrame([(0.5,), (0.0,), (7.0,), (-1.0,)], "s double").select(bucket(F.col("s"))).collect()] == [3, 0, 5, 0]


def test_index(spark, blobs):
    q, r, queries, references = blobs
    root = f"{shared_dir(spark)}/test-index"
    centroids, assigned = index.build_ivf(references, clusters=5, rounds=2)
    index.save(f"{root}/ivf", assigned, "ivf", centroids)
    index.save(f"{root}/flat", references)
    meta, loaded, again = index.load(spark, f"{root}/ivf")
    assert (meta["count"], meta["clusters"]) == (900, 5)
    assert told(ivf.search(queries, again, loaded, base=5, most=5), len(q)) == brute(q, r, 5)
    with pytest.raises(ValueError, match="dims"):
        index.load(spark, f"{root}/flat", dims=3)
    assert isinstance(scorers.load(spark, f"{root}/none", f"{root}/ivf"), scorers.Ivf)
    assert isinstance(scorers.load(spark, None, f"{root}/flat"), scorers.Brute)
    assert isinstance(scorers.load(spark), scorers.Stub)
    references.limit(3).write.mode("append").parquet(f"{root}/flat/references")
    with pytest.raises(ValueError, match="rows"):
        index.load(spark, f"{root}/flat")


def test_scorers_agree(spark, blobs):
    _, _, _, references = blobs
    requests = S.generate(spark, 60)
    centroids, assigned = index.build_ivf(references, clusters=6, rounds=1)
    every = [scorers.Brute(references), scorers.Ivf(centroids, assigned, 6, 6), scorers.Cells(index.build_cells(references, 16))]
    results = [sorted(map(tuple, s.score(requests).collect())) for s in every]
    assert results[0] == results[1] == results[2] and len(results[0]) == 60
    assert scorers.VectorizeOnly().score(requests).where("approved and fraud_score = 0").count() == 60


def test_requests_are_scored_apart(spark, blobs):
    """Two requests with one id don't share their neighbours, and without references nobody is lost."""
    _, _, _, references = blobs
    requests = kept(S.generate(spark, 30))
    centroids, assigned = index.build_ivf(references, clusters=6, rounds=1)
    for s in (scorers.Brute(references), scorers.Ivf(centroids, assigned, 6, 6), scorers.Cells(index.build_cells(references, 16))):
        once = sorted(map(tuple, s.score(requests).collect()))
        twice = sorted(map(tuple, s.score(requests.unionByName(requests)).collect()))
        assert twice == sorted(once + once) and len(once) == 30
    got = scorers.Brute(references.where("false")).score(requests).collect()
    assert [(r.fraud_score, r.approved, r.status) for r in got] == [(0.6, False, "FAIL_SAFE")] * 30
    with pytest.raises(ValueError):
        knn.knn(references, references, k=7)


def test_seeds_spread_and_empty_clusters_move(spark, blobs):
    _, r, _, references = blobs
    seeds = index.spread_seeds(references, 12)
    assert seeds.count() == 12 and index.spread_seeds(references, 2000).count() == 900
    far = spark.createDataFrame([(0, *[0] * 14), (1, *[10000] * 14), (2, *[10000] * 14)], ", ".join(["cluster_id bigint", *(f"{q} int" for q in Q)]))
    moved = index.reseeded(references, far)
    assert ivf.cluster_sizes(ivf.assign(references, moved), moved).where("n = 0").count() == 0


def test_fail_safe(spark):
    got = scorers.fail_safe(spark.createDataFrame([(None, None), (0.2, True)], "fraud_score double, approved boolean")).collect()
    assert [tuple(r) for r in got] == [(0.6, False, "FAIL_SAFE"), (0.2, True, "OK")]


@pytest.mark.parametrize("sent", [1 << 26, 20_000, 0])
def test_cap_leaves_tiles_out(spark, blobs, monkeypatch, sent):
    """Of each cluster only the tiles that a cap reaches meet queries: blocks are sent, or tiles are, or both are joined."""
    q, r, queries, references = blobs
    centroids, assigned = index.build_ivf(references, clusters=3, rounds=1)
    rows = assigned.select("ref_id", "cluster_id").orderBy("ref_id").collect()
    opened = tiles.Tiles(kept(tiles.pack(assigned.coalesce(1), rows=20)))
    monkeypatch.setattr(tiles, "BROADCAST_BYTES", sent)
    met = tiles.before(opened.frame, 60).groupBy("grp").agg(F.sum("n").alias("n"), F.max("before").alias("before")).collect()
    assert len(met) == 3 and all(x.before < 60 and x.n < 60 + 20 for x in met) and opened.count == len(r)
    first = {c: [x.ref_id for x in rows if x.cluster_id == c] for c in range(3)}
    near = ivf.shortlist(queries, centroids, 3).orderBy("qid", "probe").collect()
    want = []
    for i in range(len(q)):
        left, may = 60, []
        for x in near[3 * i : 3 * i + 3]:
            own = first[x.cluster_id]
            may += own[: max(0, left)]
            left -= len(own)
        d = ((q[i].astype(np.int64) - r[may]) ** 2).sum(axis=1)
        want.append([(may[j], int(d[j])) for j in np.lexsort((may, d))[:5]])
    assert told(ivf.search(queries, centroids, opened, base=3, most=3, cap=60), len(q)) == want
