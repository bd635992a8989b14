"""Inverted-file search: references in clusters, of which a query scans the nearest few.

The centroids are a table bounded by the number of clusters (a parameter), so that they are collected; references never are,
and queries only as blocks of a counted size. Clusters are packed as tiles in the order of reference ids, and the tiles
of the clusters that are probed are scanned where they lie (tessera.operators.tiles).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.constants import K, Q
from tessera.operators import kernel
from tessera.operators.knn import check_k
from tessera.operators.tiles import Counters, Tiles, as_tiles, blocks, scan
from tessera.plans.storage import kept

MOST_CLUSTERS = 65_536
#: Bytes of a matrix of distances to centroids that a task holds at a time.
STRIP_BYTES = 32 << 20


def centroid_matrix(centroids: DataFrame | tuple[np.ndarray, np.ndarray], vector: Sequence[str] = tuple(Q)) -> tuple[np.ndarray, np.ndarray]:
    """(cluster ids, matrix), by id; their number is bounded by MOST_CLUSTERS. What is such a pair already stays."""
    if isinstance(centroids, tuple):
        return centroids
    rows = centroids.select("cluster_id", *vector).orderBy("cluster_id").limit(MOST_CLUSTERS + 1).toPandas()
    if len(rows) > MOST_CLUSTERS:
        raise ValueError(f"more than {MOST_CLUSTERS} clusters")
    return rows["cluster_id"].to_numpy(np.int64), rows[list(vector)].to_numpy(np.float64)


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]


def assign(rows: DataFrame, centroids: DataFrame, vector: Sequence[str] = tuple(Q)) -> DataFrame:
    """rows with cluster_id, the nearest centroid; ties go to the smaller id."""
    ids, c = centroid_matrix(centroids, vector)

    @F.pandas_udf("bigint")
    def of(*columns: pd.Series) -> pd.Series:
        x = np.stack([s.to_numpy(np.float64) for s in columns], axis=1)
        out = np.empty(len(x), np.int64)
        step = max(1, STRIP_BYTES // (8 * len(c)))
        for s in range(0, len(x), step):
            out[s : s + step] = ids[_distances(x[s : s + step], c).argmin(axis=1)]
        return pd.Series(out)

    return rows.withColumn("cluster_id", of(*vector))


def _nearest_few(d: np.ndarray, n: int) -> np.ndarray:
    """For each row the columns of its n smallest values, ordered by value and column."""
    if n >= d.shape[1]:
        return np.argsort(d, axis=1, kind="stable")
    bound = np.partition(d, n - 1, axis=1)[:, n - 1]
    i, j = np.nonzero(d <= bound[:, None])
    sort = np.lexsort((j, d[i, j], i))
    i, j = i[sort], j[sort]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    return j[rank < n].reshape(-1, n)


def shortlist(queries: DataFrame, centroids: DataFrame, probes: int, vector: Sequence[str] = tuple(Q), query_id: str = "qid") -> DataFrame:
    """(qid, probe, cluster_id, cd2): the nearest `probes` centroids of every query, probe 1 being the nearest."""
    ids, c = centroid_matrix(centroids, vector)
    n = min(probes, len(ids))
    step = max(1, STRIP_BYTES // (8 * len(ids)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for s in range(0, len(f), step):
                part = f.iloc[s : s + step]
                d = _distances(part[list(vector)].to_numpy(np.float64), c)
                order = _nearest_few(d, n)
                i = np.repeat(np.arange(len(part)), order.shape[1])
                j = order.ravel()
                yield pd.DataFrame({"qid": part["qid"].to_numpy(np.int64)[i], "probe": np.tile(np.arange(1, order.shape[1] + 1), len(part)), "cluster_id": ids[j], "cd2": d[i, j].astype(np.int64)})

    return queries.select(F.col(query_id).cast("bigint").alias("qid"), *vector).mapInPandas(run, "qid bigint, probe int, cluster_id bigint, cd2 bigint")


def cluster_sizes(assigned: DataFrame | Tiles, centroids: DataFrame) -> DataFrame:
    """(cluster_id, n) of every cluster, empty ones included; assigned is references with cluster_id, or their tiles."""
    frame = assigned.frame if isinstance(assigned, Tiles) else assigned
    packed = "grp" in frame.columns
    counts = frame.groupBy(F.col("grp").alias("cluster_id")).agg(F.sum("n").alias("n")) if packed else frame.groupBy("cluster_id").agg(F.count("*").alias("n"))
    return centroids.select("cluster_id").join(counts, "cluster_id", "left").select("cluster_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def cluster_stats(sizes: DataFrame) -> DataFrame:
    """p50, p99, most and empty of the cluster sizes; the percentiles are at position int(n * p) of the sorted sizes."""
    listed = sizes.agg(F.array_sort(F.collect_list("n")).alias("s"), F.count("*").cast("int").alias("clusters"), F.count_if(F.col("n") == 0).alias("empty"))
    at = lambda p: F.get("s", F.least(F.floor(F.col("clusters") * p).cast("int"), F.col("clusters") - 1))
    return listed.select(F.col("clusters").cast("bigint").alias("clusters"), at(0.5).alias("p50"), at(0.99).alias("p99"), F.get("s", F.col("clusters") - 1).alias("most"), "empty")


def _few(centroids: DataFrame, first: int, last: int, sizes: dict[int, int] | None, cap: int | None, vector: Sequence[str]) -> Callable:
    """What tiles.blocks asks: for each query its centroids from the first-th to the last-th nearest. With cap, a query may
    scan so many references over all its clusters, in the order of distance and id."""
    ids, c = centroid_matrix(centroids, vector)
    n = np.array([(sizes or {}).get(int(i), 0) for i in ids], np.int64)
    strip = max(1, STRIP_BYTES // (8 * max(1, len(ids))))
    last = min(last, len(ids))

    def choose(x: np.ndarray, _) -> tuple:
        if first > last:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), None, None
        near = np.concatenate([_nearest_few(_distances(x[s : s + strip].astype(np.float64), c), last) for s in range(0, max(1, len(x)), strip)])
        rows, takes = np.repeat(np.arange(len(x)), last - first + 1), None
        if cap is not None:
            inside = n[near]
            takes = np.minimum(inside, cap - (np.cumsum(inside, axis=1) - inside))[:, first - 1 :].ravel()
        groups = ids[near[:, first - 1 :]].ravel()
        counted = [] if sizes is None else [(int(n[near[:, first - 1 :]].sum() if takes is None else np.maximum(takes, 0).sum()), 0, 0)]
        if takes is None:
            return rows, groups, None, None, *counted
        open_ = takes > 0
        return rows[open_], groups[open_], takes[open_], None, *counted

    return choose


def search(queries: DataFrame, centroids: DataFrame, assigned: DataFrame | Tiles, base: int = 6, most: int = 16, refine: tuple[int, int] = (2, 4), cap: int | None = None, k: int = K, vector: Sequence[str] = tuple(Q), query_id: str = "qid", counters: Counters | None = None) -> DataFrame:
    """(qid, ref_id, d2, fraud, rank) by scanning the `base` nearest clusters.

    Queries whose fraud count lies in `refine` go on to `most` clusters. cap bounds the references scanned by a query
    over both passes. With base = most = clusters and no cap the result is exact. k is 1 to 5.
    """
    check_k(k)
    index = as_tiles(assigned, "cluster_id", vector)
    sizes = None if cap is None and counters is None else index.sizes

    def scanned(asking: DataFrame, first: int, last: int, known: DataFrame | None = None) -> DataFrame:
        asked = blocks(asking, _few(centroids, first, last, sizes, cap, vector), vector, query_id)
        return scan(index, asked, len(vector), k, cap=cap, counters=counters, known=known)

    if most <= base:
        return kernel.best(scanned(queries, 1, base), k)
    first = kept(kernel.best(scanned(queries, 1, base), k))
    undecided = first.groupBy("qid").agg(F.sum("fraud").alias("f")).where(F.col("f").between(*refine)).select(F.col("qid").alias(query_id))
    more = scanned(queries.join(undecided, query_id, "left_semi"), base + 1, most, first)
    return kernel.best(first.drop("rank").unionByName(more), k)


def sweep(queries: DataFrame, centroids: DataFrame, assigned: DataFrame | Tiles, settings: Sequence[int], k: int = K, vector: Sequence[str] = tuple(Q), query_id: str = "qid") -> DataFrame:
    """(setting, qid, ref_id, d2, fraud, rank) for each number of probes of settings, all from one scan: what is found in a
    cluster counts for every setting that probes it."""
    check_k(k)
    index, steps = as_tiles(assigned, "cluster_id", vector), sorted(set(settings))
    near = _few(centroids, 1, steps[-1], None, None, vector)

    def choose(x: np.ndarray, more) -> tuple:
        rows, groups, takes, *_ = near(x, more)
        width = len(rows) // max(1, len(x))
        return rows, groups, takes, np.tile(np.searchsorted(steps, np.arange(1, width + 1)), len(x))

    found = scan(index, blocks(queries, choose, vector, query_id), len(vector), k, with_step=True)
    return of_steps(found, steps, k)


def of_steps(found: DataFrame, steps: Sequence[int], k: int) -> DataFrame:
    """FOUND_STEP to (setting, qid, ...): a row of step s is one of setting steps[s] and of all later ones."""
    each = found.withColumn("s", F.explode(F.sequence("step", F.lit(len(steps) - 1)))).drop("step")
    return kernel.best(each.withColumn("setting", F.element_at(F.array(*map(F.lit, steps)), F.col("s") + 1)).drop("s"), k, "setting")
