"""The same scoring on arriving requests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.plans.scorers import Scorer
from tessera.plans.storage import kept, scratch
from tessera.sources import requests as R


def bodies(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """A stream of (body) from text files, one request a line."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path).withColumnRenamed("value", "body")


def socket_bodies(spark: SparkSession, host: str, port: int) -> DataFrame:
    """A stream of (body) from a socket, one request a line. A socket can't be read again: what was under way when a query
    fails is lost, so that files or a log are for production."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load().withColumnRenamed("value", "body")


def log_bodies(spark: SparkSession, servers: str, topic: str, offsets_per_trigger: int = 1_000_000) -> DataFrame:
    """A stream of (body) from a topic of a Kafka log, where Spark's connector for it is installed."""
    rows = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("maxOffsetsPerTrigger", offsets_per_trigger).load()
    return rows.select(F.col("value").cast("string").alias("body"))


def score_batch(raw: DataFrame, scorer: Scorer) -> DataFrame:
    """(id, frauds, fraud_score, approved, error) of a batch of bodies: refused ones carry their error and no score."""
    parsed = kept(R.parse(raw))  # for the accepted and the refused ones
    good = scorer.score(R.valid(parsed)).withColumn("error", F.lit(None).cast("string"))
    return good.unionByName(R.rejected(parsed), allowMissingColumns=True)


def start(stream: DataFrame, scorer: Scorer, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False, report: Callable[[int, dict[str, int]], None] | None = None) -> StreamingQuery:
    """Scores each micro-batch and hands it to sink(frame, batch id). Requests are independent: there is no state.

    A scorer that was preloaded answers every batch from what the executors hold. What a batch keeps on its way is deleted
    once the sink has written its result. report is given the batch's number and what its search counted.
    """

    def run(batch: DataFrame, n: int) -> None:
        with scratch():
            sink(score_batch(batch, scorer), n)
            counted = getattr(scorer, "counters", None)
            if report and counted:
                report(n, counted.totals)

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)
    return (writer.trigger(availableNow=True) if once else writer).start()


def to_parquet(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that may repeat a batch: each writes a folder of its own."""
    return lambda frame, n: frame.write.mode("overwrite").parquet(f"{path}/batch={n}")
