"""Connected components by alternating large and small stars, as DataFrame operations.

Every round replaces the edges by ones that reach their component's smallest id in fewer steps; the number of rounds
grows with the logarithm of a component's diameter. A node with very many neighbours is dealt over SALTS tasks, minima
are combined before the shuffle, and each round is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored
from .skew import heavy

SALTS = 16


def _with_min(edges: DataFrame, least: DataFrame, hot: list) -> DataFrame:
    """edges (u, v) with m of least (u, m); the rows of a hot u go to SALTS tasks."""
    if not hot:
        return edges.join(least, "u")
    is_hot = F.col("u").isin(hot)
    salted = edges.withColumn("s", F.when(is_hot, F.pmod(F.xxhash64("v"), F.lit(SALTS))).otherwise(F.lit(0).cast("bigint")))
    spread = least.withColumn("s", F.explode(F.sequence(F.lit(0).cast("bigint"), F.when(is_hot, F.lit(SALTS - 1)).otherwise(F.lit(0)).cast("bigint"))))
    return salted.join(spread, ["u", "s"]).select("u", "v", "m")


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31))).alias("y")).first()
    return tuple(row)


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(id, component) for every id that has an edge; component is the smallest id reachable.

    Null ends and loops are ignored, repeated edges count once, and an empty table gives an empty one.
    """
    now = edges.select(F.greatest(a, b).cast("bigint").alias("u"), F.least(a, b).cast("bigint").alias("v")).where("u <> v").distinct()
    now = stored(now, "edges")
    was = _signature(now)
    for _ in range(rounds):
        if not was[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # a node's rows in the second star are at most its edges in the first, so that one list serves both
        hot = heavy(both.groupBy("u").agg(F.count("*").alias("n")), "u", "n", 2 * was[0])
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _with_min(both, least, hot).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _with_min(large, below, hot).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, now = now, stored(small.unionByName(below.select("u", F.col("m").alias("v"))).distinct(), "edges")
        forget(before)
        found = _signature(now)
        if found == was:
            break
        was = found
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
