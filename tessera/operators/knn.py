"""Exact nearest neighbours: every query against every reference, by tiles; and the readable relational form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.constants import K, Q
from tessera.functions.vectors import squared_distance
from tessera.operators import kernel, parts
from tessera.plans.storage import forget, kept

QUERY_ROWS, REFERENCE_ROWS = 1024, 8192
#: Bytes of packed references up to which they are broadcast; beyond it tiles are paired by a shuffle.
BROADCAST_BYTES = 192 << 20


def check_k(k: int, most: int = K) -> int:
    if not 1 <= k <= most:
        raise ValueError(f"k is {k}; 1 to {most} are supported")
    return k


def packed(references: DataFrame, vector: Sequence[str] = tuple(Q)) -> DataFrame:
    """References as tiles, which an engine that is asked again keeps."""
    return kernel.pack(references, "ref_id", vector, "fraud", REFERENCE_ROWS)


def knn(queries: DataFrame, references: DataFrame, k: int = K, vector: Sequence[str] = tuple(Q), query_id: str = "qid", broadcast_bytes: int = BROADCAST_BYTES, rows: int | None = None) -> DataFrame:
    """(qid, ref_id, d2, fraud, rank): the k nearest references of every query by (d2, ref_id).

    references is (ref_id, vector columns, fraud), or packed; rows is their number, if it is known. A task gives at most k rows a query, however many pairs of tiles it
    compares, so that what is shuffled grows with the queries times the tasks. Where pairs are many, references are searched
    by parts that lie apart (tessera.operators.parts), with the same result. k is 1 to 5.
    """
    check_k(k)
    is_packed = "ids" in references.columns
    if rows is None:
        rows = (references.agg(F.sum("n")).first()[0] or 0) if is_packed else references.count()
    if parts.fits({0: rows}, {0: queries.count() if rows else 0}):
        divided = references.__dict__.get("divided")
        if divided is None:
            whole = kept((references if is_packed else packed(references, vector)).select(F.lit(0).cast("bigint").alias("grp"), "n", "ids", "data", "extra"))
            divided = parts.divide(whole, len(vector), {0: rows})
            forget(whole)
            references.divided = divided
        return kernel.best(parts.search(parts.rows_of_all(queries, vector, query_id), divided, k), k)
    q = kernel.pack(queries.withColumn("__no", F.lit(0)), query_id, vector, "__no", QUERY_ROWS)
    # a batch may come from one file: its tiles are dealt over all tasks
    context = queries.sparkSession.sparkContext
    tasks = max(context.defaultParallelism, int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    q = q.select(F.col("ids").alias("q_ids"), F.col("data").alias("q_data")).repartition(tasks)
    r = (references if is_packed else packed(references, vector)).select("ids", "data", "extra")
    if rows * (4 * len(vector) + 12) <= broadcast_bytes:
        r = F.broadcast(r)
    return kernel.best(kernel.search(q.crossJoin(r), len(vector), k), k)


def knn_relational(queries: DataFrame, references: DataFrame, k: int = K, vector: Sequence[str] = tuple(Q), query_id: str = "qid") -> DataFrame:
    """The same as joins and a window: for small inputs, as it ranks every pair."""
    q = queries.select(F.col(query_id).alias("qid"), *[F.col(v).alias(f"a_{v}") for v in vector])
    pairs = q.crossJoin(references.select("ref_id", "fraud", *vector))
    d2 = squared_distance([F.col(f"a_{v}") for v in vector], [F.col(v) for v in vector])
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("d2", "ref_id"))
    found = pairs.select("qid", "ref_id", d2.alias("d2"), "fraud")
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
