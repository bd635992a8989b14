"""Requests: JSON bodies to typed rows, with the reason where one is refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.constants import MCC_RISK
from tessera.schema import RAW_REQUEST

MAX_BODY_BYTES = 8192

#: Merchant codes of generated requests: those with a risk of their own, and two without.
GENERATED_MCCS = (*MCC_RISK, "1520", "8299")
#: Draws of a generated request, in the order of their numbers.
DRAWS = ("cents", "instalments", "second", "usual", "today", "merchant", "friend", "code", "shop", "flags", "home", "gap", "away")


def parse(raw: DataFrame, body: str = "body", keep: tuple[str, ...] = ()) -> DataFrame:
    """keep, the columns of schema.REQUEST, and error: null, or why the body is refused.

    Every scalar is read as text and cast on its own, so that a mistyped number is 0 and not a lost struct; unknown
    fields are ignored at every level; missing numbers are 0 and missing flags false.
    """
    text = F.col(body)
    r = F.from_json(text, RAW_REQUEST, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    # the optimizer copies a projected struct into every place that names one of its fields, also into filters, but not
    # what a generator gives: the text is parsed once a row
    rows = raw.select(*keep, text.alias("__body"), F.explode(F.array(r)).alias("r"))
    got = lambda path: F.col(f"r.{path}")
    number = lambda path: F.coalesce(got(path).try_cast("double"), F.lit(0.0))
    whole = lambda path: F.coalesce(got(path).try_cast("double").try_cast("int"), F.lit(0))
    flag = lambda path: F.coalesce(got(path).try_cast("boolean"), F.lit(False))
    moment = lambda path: F.try_to_timestamp(got(path))
    object_like = F.trim("__body").startswith("{")
    is_bad = F.col("__body").isNull() | ~object_like | got("_corrupt").isNotNull() | F.col("r").isNull()
    error = (
        F.when(F.octet_length("__body") > MAX_BODY_BYTES, "too_large")
        .when(is_bad, "bad_json")
        .when(got("id").isNull(), "missing_id")
        .when(got("transaction").isNull(), "missing_transaction")
        .when(got("customer").isNull(), "missing_customer")
        .when(got("merchant").isNull(), "missing_merchant")
        .when(got("terminal").isNull(), "missing_terminal")
        .when(got("transaction.requested_at").isNull(), "missing_requested_at")
        .when(moment("transaction.requested_at").isNull(), "bad_requested_at")
        .when(got("last_transaction.timestamp").isNotNull() & moment("last_transaction.timestamp").isNull(), "bad_last_timestamp")
    )
    last = F.when(
        got("last_transaction").isNotNull(),
        F.struct(moment("last_transaction.timestamp").alias("timestamp"), number("last_transaction.km_from_current").alias("km_from_current")),
    )
    return rows.select(
        *keep,
        got("id").alias("id"),
        F.struct(number("transaction.amount").alias("amount"), whole("transaction.installments").alias("installments"), moment("transaction.requested_at").alias("requested_at")).alias("transaction"),
        F.struct(number("customer.avg_amount").alias("avg_amount"), whole("customer.tx_count_24h").alias("tx_count_24h"), got("customer.known_merchants").alias("known_merchants")).alias("customer"),
        F.struct(got("merchant.id").alias("id"), got("merchant.mcc").alias("mcc"), number("merchant.avg_amount").alias("avg_amount")).alias("merchant"),
        F.struct(flag("terminal.is_online").alias("is_online"), flag("terminal.card_present").alias("card_present"), number("terminal.km_from_home").alias("km_from_home")).alias("terminal"),
        last.alias("last_transaction"),
        error.alias("error"),
    )


def valid(parsed: DataFrame) -> DataFrame:
    return parsed.where("error is null").drop("error")


def rejected(parsed: DataFrame, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    return parsed.where("error is not null").select(*keep, "error")


def to_body(requests: DataFrame, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """keep and the JSON body of typed requests."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    tx, last = F.col("transaction"), F.col("last_transaction")
    whole = F.struct(
        "id",
        F.struct(tx["amount"].alias("amount"), tx["installments"].alias("installments"), iso(tx["requested_at"]).alias("requested_at")).alias("transaction"),
        "customer",
        "merchant",
        "terminal",
        F.when(last.isNotNull(), F.struct(iso(last["timestamp"]).alias("timestamp"), last["km_from_current"].alias("km_from_current"))).alias("last_transaction"),
    )
    return requests.select(*keep, F.to_json(whole).alias("body"))


def route(method: Column, path: Column, body_bytes: Column) -> Column:
    """The status of a call before its body is read: 200, 404, 405 or 413."""
    known = path.isin("/ready", "/fraud-score")
    wanted = F.when(path == "/ready", "GET").otherwise("POST")
    return F.when(~known, 404).when(method != wanted, 405).when(body_bytes > MAX_BODY_BYTES, 413).otherwise(200)


def draw(what: str, most: int, seed: int = 42) -> Column:
    """A whole number from 0 to most - 1 for row n: two steps of a multiplicative generator modulo 2 ** 31 - 1."""
    start = (F.col("n") + 1) * (7919 + 2 * DRAWS.index(what)) + seed
    return (start % 2147483647 * 48271 % 2147483647 * 16807 % 2147483647) % most


def generate(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """n synthetic requests, of the numbers from 0 on."""
    return generate_of(spark.range(n).withColumnRenamed("id", "n"), seed)


def generate_of(numbers: DataFrame, seed: int = 42) -> DataFrame:
    """A synthetic request for each row of numbers (n), each plain arithmetic on its number.

    Requests are spread over four weeks; amounts are squares, so that small ones are common; a customer's first merchant
    is the one at hand in a third of the requests, and one in five has no transaction before.
    """
    d = lambda what, most: draw(what, most, seed)
    at = F.lit(1_767_225_600) + d("second", 28 * 86_400)
    shop = lambda number: F.concat(F.lit("shop-"), number.cast("string"))
    friend = F.when(d("friend", 3) == 0, d("merchant", 500)).otherwise(500 + d("friend", 500))
    euros = lambda c: (c / F.lit(100.0)).cast("double")
    root = d("cents", 1_200)
    flags = d("flags", 4)
    last = F.struct(F.timestamp_seconds(at - 60 * (1 + d("gap", 3_000))).alias("timestamp"), (d("away", 9_000) / F.lit(8.0)).alias("km_from_current"))
    return numbers.select(
        F.concat(F.lit("made-"), F.col("n").cast("string")).alias("id"),
        F.struct(euros(root * root + 50).alias("amount"), (1 + d("instalments", 18)).cast("int").alias("installments"), F.timestamp_seconds(at).alias("requested_at")).alias("transaction"),
        F.struct(euros(d("usual", 250_000)).alias("avg_amount"), d("today", 30).cast("int").alias("tx_count_24h"), F.array(shop(friend)).alias("known_merchants")).alias("customer"),
        F.struct(shop(d("merchant", 500)).alias("id"), F.element_at(F.array(*map(F.lit, GENERATED_MCCS)), (1 + d("code", len(GENERATED_MCCS))).cast("int")).alias("mcc"), euros(d("shop", 1_500_000)).alias("avg_amount")).alias("merchant"),
        F.struct((flags % 2 == 1).alias("is_online"), (flags >= 2).alias("card_present"), (d("home", 12_000) / F.lit(8.0)).alias("km_from_home")).alias("terminal"),
        F.when(d("gap", 5) != 0, last).alias("last_transaction"),
    )


def risks(spark: SparkSession) -> DataFrame:
    """The table of category risks."""
    return spark.createDataFrame(list(MCC_RISK.items()), "mcc string, risk double")
