"""Cells by splitting all nodes of a level at once: the widest dimension, and an exact rank in it.

The rows of a node are ordered by (coordinate, ref_id). By the rule `median` the first half goes left; by `midpoint` what
lies below the middle of the node's range, but at least a ninth of the rows goes to either side. As ids settle equal
coordinates, cells have the sizes that the rule says whatever the ties, and rows that are all equal are split, too.

The ends of the nodes and their cuts (one row a node, at most MOST_CELLS) are what the driver sees. Ranks are found by
counting, so that no task holds a node: each value by itself where there are few, else ranges (tessera.operators.selection).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.constants import Q
from tessera.operators.boxes import MOST_CELLS
from tessera.operators.selection import nth
from tessera.plans.storage import forget, kept

#: The least part of a node's rows on one side of a split at the middle.
LEAST_SIDE = 9
#: Different values of a node, and ranges of its ids, up to which each is counted by itself in one pass.
MOST_VALUES = 65_536


def _counted(values: DataFrame, told: DataFrame, rule: str) -> dict[int, tuple[int, int]]:
    """{cell: (cut, rest)} of nodes with less than MOST_VALUES values, from one count of each value."""
    cell = Window.partitionBy("cell_id")
    n = F.sum("n").over(cell.orderBy("value"))
    counts = values.groupBy("cell_id", "value").agg(F.count("*").alias("n")).join(told, "cell_id")
    at = F.floor(F.col("total") / 2)
    if rule == "midpoint":
        side = F.greatest(F.floor(F.col("total") / LEAST_SIDE), F.lit(1).cast("bigint"))
        below = F.sum(F.when(2 * F.col("value") < F.col("twice"), F.col("n")).otherwise(0)).over(cell)
        at = F.when(F.col("uneven") & (F.col("total") > 2), F.least(F.greatest(below, side), F.col("total") - side)).otherwise(at)
    ranked = counts.select("cell_id", "value", at.alias("at"), "n", (n - F.col("n")).alias("before"))
    found = ranked.where((F.col("before") <= F.col("at")) & (F.col("at") < F.col("before") + F.col("n")))
    return {r["cell_id"]: (r["value"], r["rest"]) for r in found.select("cell_id", "value", (F.col("at") - F.col("before")).alias("rest")).collect()}


def _ids(equal: DataFrame, tied: list[tuple]) -> dict[int, int]:
    """{cell: the id with `rest` ids of its cell before it}; ids are unique. A pass counts ranges of ids, the next sorts one."""
    spark = equal.sparkSession
    low, high = equal.agg(F.min("ref_id"), F.max("ref_id")).first()
    width = (high - low) // MOST_VALUES + 1
    if width > MOST_VALUES:
        return {r["cell_id"]: r["ref_id"] for r in nth(equal.select("cell_id", "ref_id"), spark.createDataFrame([(c, rest) for c, _, rest in tied], "cell_id bigint, at bigint"), ["cell_id"], "ref_id").collect()}
    ranged = equal.withColumn("range", F.floor((F.col("ref_id") - low) / F.lit(width)))
    counts = ranged.groupBy("cell_id", "rest", "range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("cell_id").orderBy("range")) - F.col("n")
    chosen = counts.withColumn("before", before).where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("n")))
    one = spark.createDataFrame(chosen.select("cell_id", "range", (F.col("rest") - F.col("before")).alias("left")).collect(), "cell_id bigint, range bigint, left bigint")
    within = ranged.join(F.broadcast(one), ["cell_id", "range"])
    rank = F.row_number().over(Window.partitionBy("cell_id").orderBy("ref_id")) - 1  # at most `width` rows a cell
    return {r["cell_id"]: r["ref_id"] for r in within.withColumn("place", rank).where("place = left").select("cell_id", "ref_id").collect()}


def split(references: DataFrame, depth: int, rule: str = "median", least: int = 1, vector: Sequence[str] = tuple(Q)) -> DataFrame:
    """references with cell_id, after `depth` levels of splits: the root is 1, node i has the children 2 i and 2 i + 1.

    Nodes of at most `least` rows stay whole. The result is a kept table.
    """
    if rule not in ("median", "midpoint"):
        raise ValueError("cells are split by median or by midpoint")
    if not 0 <= depth or 1 << depth > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} cells")
    spark, vector = references.sparkSession, list(vector)
    rows = kept(references.withColumn("cell_id", F.lit(1).cast("bigint")))
    for level in range(depth):
        edges = [f(v).cast("bigint").alias(f"{p}_{v}") for v in vector for f, p in ((F.min, "lo"), (F.max, "hi"))]
        nodes = rows.where(F.col("cell_id") >= 1 << level).groupBy("cell_id").agg(F.count("*").alias("n"), *edges).where(F.col("n") > max(1, least)).collect()
        if not nodes:
            break
        asked, widest = [], 0
        for r in nodes:
            ranges = [r[f"hi_{v}"] - r[f"lo_{v}"] for v in vector]
            wide = ranges.index(max(ranges))  # the first of equally wide ones
            asked.append((r["cell_id"], wide, r[f"lo_{vector[wide]}"] + r[f"hi_{vector[wide]}"], max(ranges) > 0, r["n"]))
            widest = max(widest, max(ranges))
        told = F.broadcast(spark.createDataFrame(asked, "cell_id bigint, wide int, twice bigint, uneven boolean, total bigint"))
        # ranks are counted in several passes, which read these few columns
        values = kept(rows.join(told, "cell_id").select("cell_id", "ref_id", F.element_at(F.array(*vector), F.col("wide") + 1).cast("bigint").alias("value"), "twice"))
        if widest < MOST_VALUES:
            cuts = _counted(values, told, rule)
        else:
            if rule == "median":
                wanted = [(a[0], a[4] // 2) for a in asked]
            else:
                below = {r["cell_id"]: r["below"] for r in values.groupBy("cell_id").agg(F.count_if(2 * F.col("value") < F.col("twice")).alias("below")).collect()}
                wanted = []
                for cell, _, _, uneven, n in asked:
                    side = max(1, n // LEAST_SIDE)
                    wanted.append((cell, min(max(below[cell], side), n - side) if uneven and n > 2 else n // 2))
            cuts = {r["cell_id"]: (r["value"], r["rest"]) for r in nth(values, spark.createDataFrame(wanted, "cell_id bigint, at bigint"), ["cell_id"]).collect()}
        # of rows that are equal to the cut, those with the smaller ids go left
        tied = [(c, v, rest) for c, (v, rest) in cuts.items() if rest > 0]
        ids = {}
        if tied:
            equal = values.join(F.broadcast(spark.createDataFrame(tied, "cell_id bigint, cut bigint, rest bigint")), "cell_id").where("value = cut")
            ids = _ids(equal.select("cell_id", "ref_id", "rest"), tied)
        table = spark.createDataFrame([(c, a[1], *cuts[c][:1], ids.get(c)) for a in asked for c in a[:1]], "cell_id bigint, wide int, cut bigint, cut_id bigint")
        x = F.element_at(F.array(*vector), F.col("wide") + 1).cast("bigint")
        left = (x < F.col("cut")) | ((x == F.col("cut")) & F.coalesce(F.col("ref_id") < F.col("cut_id"), F.lit(False)))
        moved = rows.join(F.broadcast(table), "cell_id", "left").withColumn("cell_id", F.when(F.col("wide").isNull(), F.col("cell_id")).when(left, F.col("cell_id") * 2).otherwise(F.col("cell_id") * 2 + 1))
        new = kept(moved.drop("wide", "cut", "cut_id"))
        forget(rows, values)
        rows = new
    return rows
