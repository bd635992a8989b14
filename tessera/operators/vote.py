"""From neighbours to a score, a decision and a response."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.constants import THRESHOLD, K


def vote(neighbours: DataFrame, n_references: int, k: int = K, threshold: float = THRESHOLD, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, qid, frauds, fraud_score, approved). Frauds are divided by min(k, all references), so that missing ones are legit."""
    score = F.sum("fraud").cast("double") / float(max(1, min(k, n_references)))
    return neighbours.groupBy(*keys, "qid").agg(F.sum("fraud").cast("bigint").alias("frauds"), score.alias("fraud_score")).withColumn("approved", F.col("fraud_score") < threshold)


def bucket(score: Column) -> Column:
    """The number of frauds, 0 to 5, that a score stands for in a response: halves go up."""
    return F.least(F.greatest(F.floor(score * 5 + 0.5), F.lit(0)), F.lit(5)).cast("int")


def response_body(frauds: Column) -> Column:
    """The JSON of a response: fewer than three frauds are approved."""
    return F.to_json(F.struct((frauds < 3).alias("approved"), (frauds / 5.0).alias("fraud_score")))


def respond(scored: DataFrame) -> DataFrame:
    """Adds http_frauds, http_status and http_body; a missing score is the fail-safe: denied with 0.6."""
    frauds = bucket(F.coalesce("fraud_score", F.lit(THRESHOLD)))
    return scored.withColumns({"http_frauds": frauds, "http_status": F.lit(200), "http_body": response_body(frauds)})
