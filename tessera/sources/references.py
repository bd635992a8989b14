"""References and labelled corpora: JSON (also gzipped) or rows in memory, to quantized columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.constants import DIMS, Q
from tessera.functions.vectors import quantize
from tessera.schema import REFERENCE

CORPUS = "entries array<struct<request:string,expected_approved:boolean>>"


def read_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(vector, label) of a JSON array, or of JSON lines, which large files should be: an array is one task."""
    return spark.read.schema(REFERENCE).option("multiLine", not lines).option("mode", "FAILFAST").json(path)


def of(spark: SparkSession, vectors: Iterable[Iterable[float]], frauds: Iterable[bool]) -> DataFrame:
    rows = [([float(x) for x in v], "fraud" if f else "legit") for v, f in zip(vectors, frauds, strict=True)]
    return spark.createDataFrame(rows, REFERENCE)


def references(raw: DataFrame, dims: int = DIMS, id_col: str | None = None) -> DataFrame:
    """(ref_id, q0.., fraud). A missing vector or one of another length is an error; any label but fraud is legit.

    Without id_col the ids follow the order of the rows in the files.
    """
    size = F.size("vector")
    told = F.when(F.col("vector").isNull(), F.raise_error(F.lit("a reference has no vector"))).when(size != dims, F.raise_error(F.concat(F.lit("a vector has not the wanted length but "), size.cast("string"))))
    ref_id = F.monotonically_increasing_id() if id_col is None else F.col(id_col)
    checked = raw.withColumn("vector", F.when(told.cast("string").isNotNull(), F.lit(None)).otherwise(F.col("vector")))
    names = Q if dims == DIMS else [f"q{i}" for i in range(dims)]
    return checked.select(ref_id.alias("ref_id"), *[quantize(F.get("vector", F.lit(i))).alias(q) for i, q in enumerate(names)], (F.col("label") == "fraud").cast("int").alias("fraud"))


def read_corpus(spark: SparkSession, path: str, limit: int | None = None, lines: bool = False) -> DataFrame:
    """(entry, body, expected_approved) of labelled corpora, one a file or, with lines, one a line; limit keeps the first
    entries of each."""
    rows = spark.read.schema(CORPUS).option("multiLine", not lines).json(path)
    out = rows.select(F.posexplode("entries").alias("entry", "e")).select("entry", F.col("e.request").alias("body"), F.col("e.expected_approved").alias("expected_approved"))
    return out if limit is None else out.where(F.col("entry") < limit)
