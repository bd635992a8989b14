"""Quantization and distances of vectors held as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.constants import SCALE, Q, V


def quantize(x: Column, scale: int = SCALE) -> Column:
    """x cut to [-1, 1], times the scale, halves up; NaN gives 0. One rule for references and queries."""
    cut = F.least(F.greatest(x.cast("double"), F.lit(-1.0)), F.lit(1.0))
    return F.when(F.isnan(x.cast("double")), 0).otherwise(F.floor(cut * scale + 0.5).cast("int"))


def dequantize(q: Column, scale: int = SCALE) -> Column:
    return q.cast("double") / scale


def quantized(df: DataFrame, keep: Sequence[str] = ("id",), vector: Sequence[str] = tuple(V), out: Sequence[str] = tuple(Q)) -> DataFrame:
    """The columns are quantized as one array: written out for each, they and what computes them made a generated method of
    more than 8,000 bytes, which the JVM never compiles."""
    rows = quantized_array(df.select(*keep, F.array(*[F.col(v).cast("double") for v in vector]).alias("__v")), "__v", keep, "__q")
    return rows.select(*keep, *[F.get("__q", F.lit(i)).alias(q) for i, q in enumerate(out)])


def quantized_array(df: DataFrame, vector: str, keep: Sequence[str], out: str = "q") -> DataFrame:
    """The same for a vector in an array column."""
    return df.select(*keep, F.transform(vector, lambda x: quantize(x)).alias(out))


def squared_distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """The sum of squared differences as a bigint, written out so that it is compiled."""
    total = F.lit(0).cast("bigint")
    for x, y in zip(a, b, strict=True):
        d = x.cast("bigint") - y.cast("bigint")
        total = total + d * d
    return total


def box_distance(q: Sequence[Column], low: Sequence[Column], high: Sequence[Column]) -> Column:
    """The least squared distance from a point to any point of a box."""
    total = F.lit(0).cast("bigint")
    for x, a, b in zip(q, low, high, strict=True):
        d = F.greatest((a - x).cast("bigint"), (x - b).cast("bigint"), F.lit(0).cast("bigint"))
        total = total + d * d
    return total
