"""Order statistics of large groups by counting: the value that has so many before it, without sorting a group anywhere.

The values between the ends of a group are counted by RANGES ranges; the one that holds the wanted rank becomes the next
ends, until it holds one value. A window over the counts has at most RANGES rows for a wanted rank, whatever the group's
size, and a round reads the rows once. Every round tells the least from the greatest value that are left, so it ends.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 4096
#: Ranks that can be asked at a time: what a round leaves of them is collected.
MOST_RANKS = 131_072


def _range_of(value: Column, low: Column, high: Column, even: bool) -> Column:
    """The range, 0 to RANGES - 1, in which value lies between low and high: it never falls where value rises.

    Even rounds divide evenly, odd ones by powers of two, so that values of any magnitude are told apart in a few rounds.
    """
    if even:  # halves keep the difference of very large numbers finite
        of = lambda x: x.cast("double") / 2
    else:
        # infinities count as the next powers
        power = lambda x: F.least(F.coalesce(F.log2(F.abs(x.cast("double"))), F.lit(-1075.0)), F.lit(1025.0))
        of = lambda x: F.when(x.cast("double") == 0, 0.0).otherwise(F.signum(x.cast("double")) * (power(x) + 1076))
    width = of(high) - of(low)
    part = (of(value) - of(low)) / F.when(width > 0, width).otherwise(1.0)
    inner = F.least(F.greatest(F.floor(part * RANGES), F.lit(0)), F.lit(RANGES - 1))
    return F.when(value == high, RANGES - 1).when(value == low, 0).otherwise(inner).cast("int")


def nth(rows: DataFrame, wanted: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """(keys, at, value, rest): for each (keys, at) of wanted the value with `at` rows of its group before it, in order, and
    how many of those are equal to it. rows is (keys, value), wanted at most MOST_RANKS rows; a rank beyond the group's
    rows has no result. Null values are left out, NaN comes last."""
    spark, keys = rows.sparkSession, list(keys)
    told = rows.where(F.col(value).isNotNull())
    ends = told.groupBy(*keys).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
    first = wanted.join(ends, keys).where("at >= 0 and at < n").select(*keys, "at", F.col("at").cast("bigint").alias("rest"), "low", "high")
    schema, state = first.schema, first.limit(MOST_RANKS + 1).collect()
    if len(state) > MOST_RANKS:
        raise ValueError(f"more than {MOST_RANKS} ranks are wanted")
    one = lambda r: r["low"] == r["high"] or (r["low"] != r["low"] and r["high"] != r["high"])
    done, even = [r for r in state if one(r)], not any(isinstance(r["high"], float) and abs(r["high"] - r["low"]) > 1e15 for r in state)
    while len(done) < len(state):
        open_ = spark.createDataFrame([r for r in state if not one(r)], schema)
        met = told.join(F.broadcast(open_), keys).where(F.col(value).between(F.col("low"), F.col("high")))
        counts = met.groupBy(*keys, "at", "rest", _range_of(F.col(value), F.col("low"), F.col("high"), even).alias("range")).agg(F.count("*").alias("n"), F.min(value).alias("a"), F.max(value).alias("b"))
        upto = Window.partitionBy(*keys, "at").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        before = counts.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
        chosen = before.where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("n")))
        state = done + chosen.select(*keys, "at", (F.col("rest") - F.col("before")).alias("rest"), F.col("a").alias("low"), F.col("b").alias("high")).collect()
        done, even = [r for r in state if one(r)], not even
    return spark.createDataFrame(done, schema).select(*keys, "at", F.col("low").alias(value), "rest")
