"""Scorers: requests in, decisions out, over whichever index there is."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.constants import DIMS, THRESHOLD, K
from tessera.functions.features import vectorize
from tessera.functions.vectors import quantized
from tessera.operators import cells, ivf, knn
from tessera.operators.tiles import Counters, Tiles, as_tiles
from tessera.operators.vote import vote
from tessera.plans import index
from tessera.plans.storage import exists, forget, kept
from tessera.sources import references as R


class Scorer(Protocol):
    """score: parsed requests -> (id, frauds, fraud_score, approved, status); score_vectors: (qid, q0..) -> the same by qid,
    without status (counters, where a scorer has them, are those of the last call); preload: has the executors hold the index until release, so that no search reads its files again."""

    def score(self, requests: DataFrame) -> DataFrame: ...

    def score_vectors(self, queries: DataFrame) -> DataFrame: ...

    def preload(self) -> Scorer: ...

    def release(self) -> None: ...


class _Vectorizing:
    def score(self, requests: DataFrame) -> DataFrame:
        """Every row by itself, also where an id repeats; a row for which nothing was found gets the fail-safe."""
        # the rows are numbered once and written, as the number names them in both sides of the join
        vectors = kept(quantized(vectorize(requests.withColumn("qid", F.monotonically_increasing_id()), keep=("id", "qid")), keep=("id", "qid")))
        scored = self.score_vectors(vectors.drop("id"))
        return fail_safe(vectors.select("id", "qid").join(scored, "qid", "left")).drop("qid")


@dataclass
class Brute(_Vectorizing):
    references: DataFrame
    k: int = K

    def __post_init__(self) -> None:
        self.count = self.references.count()
        self.tiles = knn.packed(self.references)

    def score_vectors(self, queries: DataFrame) -> DataFrame:
        return vote(knn.knn(queries, self.tiles, self.k, rows=self.count), self.count, self.k)

    def preload(self) -> Brute:
        self.tiles = self.tiles.persist(StorageLevel.MEMORY_AND_DISK)
        self.tiles.count()
        return self

    def release(self) -> None:
        self.tiles.unpersist()
        divided = self.tiles.__dict__.pop("divided", None)
        if divided is not None:
            forget(divided.frame)


@dataclass
class Ivf(_Vectorizing):
    centroids: DataFrame
    assigned: DataFrame | Tiles
    base: int = 6
    most: int = 16
    refine: tuple[int, int] = (2, 4)
    cap: int | None = 120_000
    k: int = K
    counters: Counters | None = None

    def __post_init__(self) -> None:
        # packed and counted once, for all searches; so are the centroids, which are bounded
        self.index = as_tiles(self.assigned)
        self.count = self.index.count
        self.near = ivf.centroid_matrix(self.centroids)

    def score_vectors(self, queries: DataFrame) -> DataFrame:
        self.counters = Counters()
        found = ivf.search(queries, self.near, self.index, self.base, self.most, self.refine, self.cap, self.k, counters=self.counters)
        return vote(found, self.count, self.k)

    def preload(self) -> Ivf:
        self.index.preload()
        return self

    def release(self) -> None:
        self.index.release()


@dataclass
class Cells(_Vectorizing):
    assigned: DataFrame | cells.Boxes
    k: int = K
    counters: Counters | None = None

    def __post_init__(self) -> None:
        self.index = cells.opened(self.assigned)
        self.count = self.index.count

    def score_vectors(self, queries: DataFrame) -> DataFrame:
        self.counters = Counters()
        return vote(cells.search(queries, self.index, self.k, counters=self.counters), self.count, self.k)

    def preload(self) -> Cells:
        self.index.tiles.preload()
        return self

    def release(self) -> None:
        self.index.tiles.release()


class Stub:
    """Approves all, without a look."""

    def preload(self) -> Stub:
        return self

    def release(self) -> None:
        pass

    def score(self, requests: DataFrame) -> DataFrame:
        return requests.select("id", F.lit(0).cast("bigint").alias("frauds"), F.lit(0.0).alias("fraud_score"), F.lit(True).alias("approved"), F.lit("OK").alias("status"))

    def score_vectors(self, queries: DataFrame) -> DataFrame:
        return self.score(queries.withColumnRenamed("qid", "id")).withColumnRenamed("id", "qid").drop("status")


class VectorizeOnly(Stub):
    """Computes the features and approves all: a baseline for what the search costs."""

    def score(self, requests: DataFrame) -> DataFrame:
        vectors = vectorize(requests)
        used = sum(F.col(f"v{i}") for i in range(DIMS))
        return super().score(vectors.where(used.isNotNull()))


def load(spark: SparkSession, cells_path: str | None = None, ivf_path: str | None = None, json_path: str | None = None) -> Scorer:
    """The first index there is: cells, then ivf (or a flat one by brute force), then JSON references, else the stub."""
    for path in (cells_path, ivf_path):
        if path and exists(spark, path):
            meta, rows, centroids = index.load(spark, path)
            return Cells(rows) if meta["kind"] == "cells" else Ivf(centroids, rows) if meta["kind"] == "ivf" else Brute(rows)
    if json_path and exists(spark, json_path):
        return Brute(R.references(R.read_json(spark, json_path)))
    return Stub()


def fail_safe(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A missing score is denied with the threshold's value, and marked."""
    missing = F.col("fraud_score").isNull()
    return scored.withColumns({"fraud_score": F.coalesce("fraud_score", F.lit(threshold)), "approved": ~missing & F.coalesce("approved", F.lit(False)), "status": F.when(missing, "FAIL_SAFE").otherwise("OK")})
