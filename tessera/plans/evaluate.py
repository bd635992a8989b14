"""Detection quality, latency percentiles, and the scores that a load test gives."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.selection import MOST_RANKS, nth


def confusion(scored: DataFrame, actual: str = "expected_approved", predicted: str = "approved", keys: Sequence[str] = ()) -> DataFrame:
    """keys, tp, tn, fp, fn (positive: denied), total, accuracy, weighted_e (fp + 3 fn), raw_errors."""
    fraud, denied = ~F.col(actual), ~F.col(predicted)
    counts = scored.groupBy(*keys).agg(F.count_if(fraud & denied).alias("tp"), F.count_if(~fraud & ~denied).alias("tn"), F.count_if(~fraud & denied).alias("fp"), F.count_if(fraud & ~denied).alias("fn"), F.count("*").alias("total"))
    right = (F.col("tp") + F.col("tn")).cast("double")
    return counts.withColumns({"accuracy": F.when(F.col("total") > 0, right / F.greatest("total", F.lit(1))), "weighted_e": F.col("fp") + 3 * F.col("fn"), "raw_errors": F.col("fp") + F.col("fn")})


def percentiles(values: DataFrame, column: str, points: Iterable[tuple[str, float]] = (("p50", 0.5), ("p90", 0.9), ("p99", 0.99), ("p999", 0.999)), keys: Sequence[str] = ()) -> DataFrame:
    """keys, n, nearest-rank percentiles and the maximum: values that occur, never interpolated.

    Ranks are found by counting, so that no task holds a group's values; the result, a row for each group, is collected.
    """
    points, groups = list(points), [f"k{i}" for i in range(max(1, len(keys)))]
    named = [F.col(k).alias(g) for k, g in zip(keys, groups, strict=False)] or [F.lit(0).alias("k0")]
    told = values.select(*named, F.col(f"`{column}`").alias("value"))
    ends = told.groupBy(*groups).agg(F.count("value").alias("n"), F.max("value").alias("most"))
    if not keys:  # a table without rows has a result, too
        ends = told.agg(F.count("value").alias("n"), F.max("value").alias("most")).withColumn("k0", F.lit(0)).select("k0", "n", "most")
    schema, rows = ends.schema, ends.limit(MOST_RANKS // max(1, len(points)) + 1).collect()
    at = {(*[r[g] for g in groups], name): max(0, math.ceil(p * r["n"]) - 1) for r in rows for name, p in points}
    spark, kinds = values.sparkSession, ", ".join(f"{g} {schema[g].dataType.simpleString()}" for g in groups)
    wanted = spark.createDataFrame(sorted({(*key[:-1], rank) for key, rank in at.items()}), f"{kinds}, at bigint")
    found = {(*[r[g] for g in groups], r["at"]): r["value"] for r in nth(told, wanted, groups).collect()}
    kind = schema["most"].dataType.simpleString()
    out = [(*[r[g] for g in groups], r["n"], *[found.get((*[r[g] for g in groups], at[(*[r[g] for g in groups], name)])) for name, _ in points], r["most"]) for r in rows]
    made = spark.createDataFrame(out, ", ".join([kinds, "n bigint", *(f"{name} {kind}" for name, _ in points), f"most {kind}"]))
    return made.toDF(*(keys or ["k0"]), *made.columns[len(groups) :]).drop(*([] if keys else ["k0"]))


def p99_score(ms: Column) -> Column:
    """0 without a time, -3000 above 2 s, else a thousand for each power of ten below one second."""
    return F.when(ms <= 0, 0.0).when(ms > 2000, -3000.0).otherwise(1000 * F.log10(1000 / F.greatest(ms, F.lit(1.0))))


def detection(fp: Column, fn: Column, errors: Column, n: Column) -> tuple[Column, Column, Column]:
    """(score, rate part, absolute part); the parts are null where more than 15 % failed, which gives -3000."""
    weighted = (fp + 3 * fn + 5 * errors).cast("double")
    cut = F.when(n > 0, (fp + fn + errors).cast("double") / F.when(n > 0, n).otherwise(1)).otherwise(0.0) > 0.15
    rate = F.when(n > 0, weighted / F.when(n > 0, n).otherwise(1)).otherwise(0.0)
    rate_part = 1000 * F.log10(1 / F.greatest(rate, F.lit(0.001)))
    absolute = -300 * F.log10(1 + weighted) + 0.0  # no negative zero
    return F.when(cut, -3000.0).otherwise(rate_part + absolute), F.when(~cut, rate_part), F.when(~cut, absolute)


def report(runs: DataFrame) -> DataFrame:
    """Runs (fp, fn, errors, n, p99) with p99_score, rate_part, absolute_part, detection_score and final_score."""
    score, rate, absolute = detection(F.col("fp"), F.col("fn"), F.col("errors"), F.col("n"))
    two = lambda c: F.round(c, 2)
    latency = p99_score(F.col("p99"))
    return runs.withColumns({"p99_score": two(latency), "rate_part": two(rate), "absolute_part": two(absolute), "detection_score": two(score), "final_score": two(latency + score)})


def sweep(scored: DataFrame, truth: DataFrame) -> DataFrame:
    """For each setting of scored (setting, qid, approved) its agreement with truth (qid, expected_approved)."""
    return confusion(scored.join(truth, "qid"), keys=("setting",))
