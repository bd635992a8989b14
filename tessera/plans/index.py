"""Building, writing and loading indexes."""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.constants import DIMS, SCALE, K, Q
from tessera.functions.vectors import squared_distance
from tessera.operators import cells, ivf, splits, tiles
from tessera.operators.boxes import Tree
from tessera.operators.tiles import Tiles
from tessera.plans.storage import kept, kept_once

VERSION = 2
#: Folders of a written index, at most.
SHARDS = 256


def seeds(references: DataFrame, clusters: int, vector: Sequence[str] = tuple(Q)) -> DataFrame:
    """(cluster_id, vector) of the references with the smallest hash of their id: a sample without randomness."""
    hashed = (F.col("ref_id") * 2654435761) % 4294967296
    chosen = references.orderBy(hashed, "ref_id").limit(clusters).select(hashed.alias("h"), "ref_id", *vector).toPandas()
    rows = [(i, *map(int, r)) for i, r in enumerate(chosen[list(vector)].itertuples(index=False))]
    return references.sparkSession.createDataFrame(rows, ", ".join(["cluster_id bigint", *(f"{v} int" for v in vector)]))


def train_sample(references: DataFrame, clusters: int, rows: int | None = None) -> DataFrame:
    """The references on which centroids are trained: of 100,000 to 200,000 rows, 50 a cluster; the smallest hashes."""
    n = rows or min(200_000, max(100_000, 50 * clusters))
    return references.orderBy(F.xxhash64("ref_id"), "ref_id").limit(n)


def lloyd(references: DataFrame, centroids: DataFrame, rounds: int, vector: Sequence[str] = tuple(Q)) -> DataFrame:
    """Centroids after so many rounds; a mean is rounded half up, and an empty cluster keeps its centroid."""
    spark = references.sparkSession
    schema = ", ".join(["cluster_id bigint", *(f"{v} int" for v in vector)])
    for _ in range(rounds):
        means = [F.floor(F.sum(F.col(v).cast("bigint")).cast("double") / F.count("*") + 0.5).cast("int").alias(v) for v in vector]
        new = ivf.assign(references, centroids, vector).groupBy("cluster_id").agg(*means)
        old = {r["cluster_id"]: r for r in centroids.collect()}  # bounded by the number of clusters
        old |= {r["cluster_id"]: r for r in new.collect()}
        centroids = spark.createDataFrame([(c, *(old[c][v] for v in vector)) for c in sorted(old)], schema)
    return centroids


def spread_seeds(sample: DataFrame, clusters: int, vector: Sequence[str] = tuple(Q), seed: int = 7) -> DataFrame:
    """(cluster_id, vector): k-means++ on a bounded sample. Each next seed is drawn with a chance that grows with its
    squared distance from the ones before, so that no dense region takes them all."""
    x = sample.orderBy("ref_id").select(*vector).toPandas().to_numpy(np.float64)  # at most train_sample's rows
    rng, chosen = np.random.default_rng(seed), []
    far = np.full(len(x), np.inf)
    for _ in range(min(clusters, len(x))):
        total = far.sum()
        at = int(rng.integers(len(x))) if not np.isfinite(total) or total == 0 else int(np.searchsorted(np.cumsum(far), rng.random() * total, side="right"))
        chosen.append(min(at, len(x) - 1))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    rows = [(i, *map(int, x[j])) for i, j in enumerate(chosen)]
    return sample.sparkSession.createDataFrame(rows, ", ".join(["cluster_id bigint", *(f"{v} int" for v in vector)]))


def reseeded(references: DataFrame, centroids: DataFrame, vector: Sequence[str] = tuple(Q)) -> DataFrame:
    """centroids, with those of empty clusters moved to the references that are farthest from their own."""
    sizes = ivf.cluster_sizes(ivf.assign(references, centroids, vector), centroids)
    empty = [r["cluster_id"] for r in sizes.where("n = 0").orderBy("cluster_id").collect()]  # bounded by the number of clusters
    if not empty:
        return centroids
    own = centroids.select("cluster_id", *[F.col(v).alias(f"c_{v}") for v in vector])
    apart = ivf.assign(references, centroids, vector).join(F.broadcast(own), "cluster_id")
    distance = squared_distance([F.col(v) for v in vector], [F.col(f"c_{v}") for v in vector])
    far = apart.select(distance.alias("d"), *vector).groupBy(*vector).agg(F.max("d").alias("d")).orderBy(F.desc("d"), *vector).limit(len(empty)).collect()
    moved = {c: r for c, r in zip(empty, far, strict=False) if r["d"] > 0}
    rows = [(r["cluster_id"], *((moved.get(r["cluster_id"]) or r)[v] for v in vector)) for r in centroids.collect()]
    return references.sparkSession.createDataFrame(rows, ", ".join(["cluster_id bigint", *(f"{v} int" for v in vector)]))


def build_ivf(references: DataFrame, clusters: int = 2048, rounds: int = 10, vector: Sequence[str] = tuple(Q), train_rows: int | None = None, start: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(centroids, references with cluster_id): k-means++ seeds or those of start, rounds of means, empty clusters seeded anew."""
    sample = kept(train_sample(references, clusters, train_rows))
    centroids = spread_seeds(sample, clusters, vector) if start is None else start
    for _ in range(rounds):
        centroids = reseeded(sample, lloyd(sample, centroids, 1, vector), vector)
    return centroids, ivf.assign(references, centroids, vector)


def build_cells(references: DataFrame, n: int = 1024, vector: Sequence[str] = tuple(Q)) -> DataFrame:
    """References with cell_id, in at most n cells that a sample shapes."""
    return cells.assign(references, cells.splits(references, n, vector), vector)


def build_levels(references: DataFrame, depth: int, rule: str = "median", vector: Sequence[str] = tuple(Q)) -> DataFrame:
    """References with cell_id, split level by level at exact ranks: a kept table."""
    return splits.split(references, depth, rule, K, vector)


def save(path: str, references: DataFrame, kind: str = "flat", centroids: DataFrame | None = None, vector: Sequence[str] = tuple(Q), shards: int = SHARDS) -> None:
    """Writes an index, and a row that describes it.

    flat: the references. ivf and cells: tiles of the clusters or cells, in a folder for each shard, which is a range of
    their numbers, so that a search reads only the shards that it asks; with the centroids, or the tree of the boxes.
    """
    spark = references.sparkSession
    told = {"version": VERSION, "kind": kind, "dims": len(vector), "scale": SCALE, "clusters": 0}
    if kind == "flat":
        references.write.mode("errorifexists").parquet(f"{path}/references")
        told["count"] = spark.read.parquet(f"{path}/references").count()
    else:
        group = {"ivf": "cluster_id", "cells": "cell_id"}[kind]
        if kind == "ivf" and centroids is None:
            raise ValueError("an ivf index needs centroids")
        references = kept_once(references)
        ends = references.agg(F.min(group).alias("a"), F.max(group).alias("b")).first()
        base, top = (ends["a"] or 0, ends["b"] or 0)
        per = -(-(top - base + 1) // shards)
        packed = tiles.pack(references, group, vector).withColumn("shard", F.floor((F.col("grp") - base) / per).cast("int"))
        packed.write.mode("errorifexists").partitionBy("shard").parquet(f"{path}/tiles")
        written = spark.read.schema(f"{tiles.TILE}, shard int").parquet(f"{path}/tiles")
        told |= {"base": base, "per": per, "count": sum(tiles.sizes(written).values())}
        if kind == "ivf":
            centroids.write.parquet(f"{path}/centroids")
            told["clusters"] = centroids.count()
        else:
            tree = Tree.of_boxes(cells.boxes(references, vector), vector)
            tree.table(spark, vector).coalesce(1).write.parquet(f"{path}/nodes")
            told["clusters"] = int(tree.cells[0])
    spark.createDataFrame([(json.dumps(told),)], "meta string").coalesce(1).write.parquet(f"{path}/meta")


def load(spark: SparkSession, path: str, dims: int = DIMS, vector: Sequence[str] = tuple(Q)) -> tuple[dict, DataFrame | Tiles | cells.Boxes, DataFrame | None]:
    """(meta, what a search takes: references, tiles or boxes; centroids or None); an index that isn't what its description
    says is refused."""
    rows = spark.read.parquet(f"{path}/meta").collect()
    if len(rows) != 1:
        raise ValueError("an index has one row of description")
    meta = json.loads(rows[0]["meta"])
    for key, want in (("version", VERSION), ("dims", dims), ("scale", SCALE)):
        if meta.get(key) != want:
            raise ValueError(f"the index has {key} {meta.get(key)}, not {want}")
    if meta["kind"] == "flat":
        references = spark.read.parquet(f"{path}/references")
        if references.count() != meta["count"]:
            raise ValueError("the index has not the rows that it says")
        return meta, references, None
    base, per = meta["base"], meta["per"]
    opened = Tiles(spark.read.schema(f"{tiles.TILE}, shard int").parquet(f"{path}/tiles"), lambda g: (g - base) // per)
    if opened.count != meta["count"]:
        raise ValueError("the index has not the rows that it says")
    if meta["kind"] == "cells":
        tree = Tree.of_table(spark.read.parquet(f"{path}/nodes"), vector)
        known = dict(zip(tree.cell.tolist(), tree.n.tolist(), strict=True))
        if any(known.get(g) != n for g, n in opened.sizes.items()) or int(tree.n[0]) != meta["count"]:
            raise ValueError("a cell has not the box or the rows that the tree says")
        return meta, cells.Boxes(opened, tree), None
    centroids = spark.read.parquet(f"{path}/centroids")
    ids = {r["cluster_id"] for r in centroids.select("cluster_id").limit(ivf.MOST_CLUSTERS + 1).collect()}
    if len(ids) != meta["clusters"]:
        raise ValueError("the index has not the clusters that it says")
    if not set(opened.sizes) <= ids:
        raise ValueError("a reference is in a cluster that has no centroid")
    return meta, opened, centroids
