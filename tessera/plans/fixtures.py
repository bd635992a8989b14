"""Transactions derived from the order tables, as this data has none: one per order that has line items.

Money stays in whole cents, so that averages don't depend on the order of summing. Every tenth order is a query, the
rest are references. The label is arithmetic noise: it serves to compare engines, never to measure detection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.constants import MCC_RISK, Q
from tessera.functions.features import vectorize
from tessera.functions.vectors import quantized

CODES = [*MCC_RISK, "0000", "0001"]


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed requests (schema.REQUEST) with ok, a whole number, and fraud."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("ok")).agg(F.min("l_suppkey").alias("mid"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("ok"), F.col("o_custkey").alias("ck"), F.floor(F.col("o_totalprice") * 100 + 0.5).cast("bigint").alias("cents"), (F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + (F.col("o_orderkey") * 7919) % 86400).alias("ep"))
    b = orders.join(items, "ok")
    customer, visits = Window.partitionBy("ck"), Window.partitionBy("ck", "mid").orderBy("ep", "ok")
    c = b.withColumns({"sc": F.sum("cents").over(customer), "nc": F.count("*").over(customer), "seen": F.row_number().over(visits), "lep": F.lag("ep").over(customer.orderBy("ep", "ok"))})
    merchant = F.concat(F.lit("M"), F.col("mid").cast("string"))
    known = F.when(F.col("seen") == 1, F.array().cast("array<string>")).otherwise(F.array(merchant))
    codes = F.array(*[F.lit(x) for x in CODES])
    last = F.when(F.col("lep").isNotNull(), F.struct(F.timestamp_seconds("lep").alias("timestamp"), ((F.col("ok") * 53) % 1300 / 1.0).cast("double").alias("km_from_current")))
    return c.select(
        "ok",
        F.when((F.col("ok") * 7919 + 13) % 100 < 25, 1).otherwise(0).alias("fraud"),
        F.concat(F.lit("tx-"), F.col("ok").cast("string")).alias("id"),
        F.struct((F.col("cents") / F.lit(4000.0)).alias("amount"), (1 + F.col("ok") % 12).cast("int").alias("installments"), F.timestamp_seconds("ep").alias("requested_at")).alias("transaction"),
        F.struct((F.col("sc") / (F.col("nc") * F.lit(4000.0))).alias("avg_amount"), (F.col("ok") % 25).cast("int").alias("tx_count_24h"), known.alias("known_merchants")).alias("customer"),
        F.struct(merchant.alias("id"), F.element_at(codes, (F.col("mid") % 12 + 1).cast("int")).alias("mcc"), ((F.col("mid") * 631) % 12000 / 1.0).cast("double").alias("avg_amount")).alias("merchant"),
        F.struct((F.col("ok") % 3 == 0).alias("is_online"), (F.col("ok") % 2 == 0).alias("card_present"), ((F.col("ck") * 37 + F.col("mid") * 101) % 1200 / 1.0).cast("double").alias("km_from_home")).alias("terminal"),
        last.alias("last_transaction"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ok, q0..q13, fraud) of all transactions."""
    made = vectorize(transactions(spark, sf_dir), keep=("ok", "fraud"))
    return quantized(made, keep=("ok", "fraud")).select("ok", *Q, "fraud")


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queries with qid, references with ref_id)."""
    return rows.where("ok % 10 = 0").withColumnRenamed("ok", "qid"), rows.where("ok % 10 <> 0").withColumnRenamed("ok", "ref_id")


def embeddings(spark: SparkSession, sf_dir: str, dims: int = 64) -> tuple[DataFrame, DataFrame, list[str]]:
    """The embeddings as a second workload: queries, references and the names of the columns."""
    from tessera.functions.vectors import quantize

    names = [f"e{i}" for i in range(dims)]
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = table.select(F.col("vec_id").alias("ok"), *[quantize(F.get("embedding", F.lit(i))).alias(n) for i, n in enumerate(names)], (F.col("label") >= 5).cast("int").alias("fraud"))
    return (*split(rows), names)
