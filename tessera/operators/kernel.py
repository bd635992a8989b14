"""Tiles of vectors, and the kernel that finds the nearest rows of one tile for another.

Vectors are packed into rows of at most so many; a pair of a tile of queries and one of references is the unit of work.
Squared distances of quantized vectors are whole numbers below 2 ** 53, so that a product of matrices in doubles is
exact. Ties go to the smaller reference id.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.topk import FOUND, TopK

TILE = "n int, ids binary, data binary, extra binary"
STRIP = 1024


def pack(df: DataFrame, id_col: str, vector: Sequence[str], extra: str, rows: int) -> DataFrame:
    """Tiles of (id, vector columns, extra): what a task reads, cut at `rows`."""
    columns = [F.col(id_col).cast("bigint").alias("id"), F.col(extra).cast("int").alias("extra"), *[F.col(v).cast("int").alias(v) for v in vector]]
    names = list(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            ids, more, data = (np.concatenate(c) for c in zip(*held, strict=True))
            return pa.RecordBatch.from_pydict({"n": pa.array([len(ids)], "int32"), "ids": [ids.tobytes()], "data": [data.tobytes()], "extra": [more.tobytes()]})

        for batch in batches:
            data = np.stack([batch[v].to_numpy() for v in names], axis=1)
            whole = batch["id"].to_numpy(), batch["extra"].to_numpy(), data
            at = 0
            while at < batch.num_rows:
                upto = min(batch.num_rows, at + rows - size)
                held.append(tuple(np.ascontiguousarray(c[at:upto]) for c in whole))
                size, at = size + upto - at, upto
                if size == rows:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return df.select(*columns).mapInArrow(run, TILE)


def nearest(q: np.ndarray, r: np.ndarray, ids: np.ndarray, k: int, take: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of q, rows of r, squared distances) of the k nearest by (distance, id); take: how many leading rows count."""
    order = np.argsort(ids, kind="stable")
    if take is not None or (order == np.arange(len(ids))).all():
        order = None
    ref = (r if order is None else r[order]).astype(np.float64)
    norm = (ref * ref).sum(axis=1)
    for s in range(0, len(q), STRIP):
        part = q[s : s + STRIP].astype(np.float64)
        d = (part * part).sum(axis=1)[:, None] - 2 * (part @ ref.T) + norm[None, :]
        if take is not None:
            d[np.arange(d.shape[1])[None, :] >= take[s : s + STRIP, None]] = np.inf
        n = min(k, d.shape[1])
        if d.shape[1] > 4 * k:
            # all that are no farther than the k-th smallest distance, so that ties are settled by id
            bound = np.partition(d, n - 1, axis=1)[:, n - 1]
            i, j = np.nonzero((d <= bound[:, None]) & np.isfinite(d))
        else:
            i, j = np.nonzero(np.isfinite(d))
        sort = np.lexsort((j, d[i, j], i))
        i, j = i[sort], j[sort]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        keep = rank < n
        i, j = i[keep], j[keep]
        yield i + s, j if order is None else order[j], d[i, j].astype(np.int64)


def search(pairs: DataFrame, dims: int, k: int) -> DataFrame:
    """FOUND of rows with a tile of queries (q_ids, q_data) and one of references (ids, data, extra): the k nearest of each
    query over all pairs of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = TopK(k)
        for batch in batches:
            for s in range(batch.num_rows):
                row = batch.slice(s, 1).to_pylist()[0]
                q_ids, ids = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
                q, r = (np.frombuffer(row[x], np.int32).reshape(-1, dims) for x in ("q_data", "data"))
                fraud = np.frombuffer(row["extra"], np.int32)
                for i, j, d in nearest(q, r, ids, k):
                    yield from held.add(q_ids[i], ids[j], d, fraud[j])
        yield from held.rows()

    return pairs.mapInArrow(run, FOUND)


def best(found: DataFrame, k: int, *keys: str) -> DataFrame:
    """FOUND with rank, of the k nearest of each query (and keys); each task has already cut its own to k."""
    rank = F.row_number().over(Window.partitionBy("qid", *keys).orderBy("d2", "ref_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
