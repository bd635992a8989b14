"""Features and quantization: worked examples, and the cases that are easy to get wrong."""

from __future__ import annotations

import math
import re

import pytest
from pyspark.sql import functions as F

from tessera.constants import V, Normalization
from tessera.functions import vectors as X
from tessera.functions.features import clamp, mcc_risk, ratio, vectorize
from tessera.plans import fixtures
from tessera.sources import requests as S

from .conftest import SF

# Two requests and their vectors.
LEGIT = """{"id":"a","transaction":{"amount":41.12,"installments":2,"requested_at":"2026-03-11T18:45:53Z"},"customer":{"avg_amount":82.24,"tx_count_24h":3,"known_merchants":["MERC-003","MERC-016"]},
"merchant":{"id":"MERC-016","mcc":"5411","avg_amount":60.25},"terminal":{"is_online":false,"card_present":true,"km_from_home":29.23},"last_transaction":null}"""
FRAUD = """{"id":"b","transaction":{"amount":9505.97,"installments":10,"requested_at":"2026-03-14T05:15:12Z"},"customer":{"avg_amount":81.28,"tx_count_24h":20,"known_merchants":["MERC-008","MERC-007","MERC-005"]},
"merchant":{"id":"MERC-068","mcc":"7802","avg_amount":54.86},"terminal":{"is_online":false,"card_present":true,"km_from_home":952.27},"last_transaction":null}"""
LEGIT_V = [0.0041, 0.1667, 0.05, 0.7826, 0.3333, -1, -1, 0.0292, 0.15, 0, 1, 0, 0.15, 0.006]
FRAUD_V = [0.9506, 0.8333, 1.0, 0.2174, 0.8333, -1, -1, 0.9523, 1.0, 0, 1, 1, 0.75, 0.0055]


def vector(spark, body, norm=None):
    row = vectorize(S.valid(S.parse(spark.createDataFrame([(body,)], "body string"))), norm).first()
    return [row[v] for v in V]


@pytest.mark.parametrize(("body", "want"), [(LEGIT, LEGIT_V), (FRAUD, FRAUD_V)])
def test_worked_examples(spark, body, want):
    assert vector(spark, body) == pytest.approx(want, abs=1e-4)


def test_own_example(spark):
    body = """{"id":"own","transaction":{"amount":1234.5,"installments":6,"requested_at":"2026-07-05T23:10:00Z"},"customer":{"avg_amount":500,"tx_count_24h":5,"known_merchants":["shop-1"]},
"merchant":{"id":"shop-1","mcc":"0000","avg_amount":2500},"terminal":{"is_online":true,"card_present":false,"km_from_home":10},"last_transaction":{"timestamp":"2026-07-05T20:10:30Z","km_from_current":250}}"""
    assert vector(spark, body) == pytest.approx([0.12345, 0.5, 0.2469, 1, 1, 179 / 1440, 0.25, 0.01, 0.25, 1, 0, 0, 0.5, 0.25])


def test_history(spark):
    body = LEGIT.replace('"last_transaction":null', '"last_transaction":{"timestamp":"2026-03-11T17:45:53Z","km_from_current":500}')
    assert vector(spark, body)[5:7] == pytest.approx([60 / 1440, 0.5])
    # minutes are whole, a later last transaction counts as none passed, and {} as one long ago
    assert vector(spark, body.replace("17:45:53", "17:45:54"))[5] == pytest.approx(59 / 1440)
    assert vector(spark, body.replace("17:45:53", "19:45:53"))[5] == 0
    assert vector(spark, LEGIT.replace('"last_transaction":null', '"last_transaction":{}'))[5:7] == [1.0, 0.0]


def test_merchants_and_codes(spark):
    assert vector(spark, LEGIT.replace('["MERC-003","MERC-016"]', "[]"))[11] == 1
    assert vector(spark, LEGIT.replace('["MERC-003","MERC-016"]', "null"))[11] == 1
    assert vector(spark, LEGIT.replace('["MERC-003","MERC-016"]', '[null,"MERC-016"]'))[11] == 0
    assert vector(spark, LEGIT.replace('"mcc":"5411"', '"mcc":"0000"'))[12] == 0.5
    assert vector(spark, LEGIT.replace('"mcc":"5411",', ""))[12] == 0.5
    assert spark.range(1).select(mcc_risk(F.lit("7995"))).first()[0] == 0.85


def test_zero_average(spark):
    assert vector(spark, LEGIT.replace("82.24", "0"))[2] == 1.0
    assert vector(spark, LEGIT.replace("82.24", "0").replace("41.12", "0"))[2] == 0.0
    assert spark.range(1).select(ratio(F.lit(1.0), F.lit(0.0))).first()[0] == math.inf


def test_normalization_can_be_given(spark):
    assert vector(spark, LEGIT, Normalization(max_amount=41.12))[0] == 1.0


def test_clamp(spark):
    got = spark.range(1).select(*[clamp(F.lit(x)) for x in (-0.1, 0.4, 7.0, math.nan)]).first()
    assert got[:3] == (0.0, 0.4, 1.0) and math.isnan(got[3])


def test_quantize(spark):
    values = [0.00005, -0.00005, -0.5, 2.0, -2.0, 0.12345, math.nan]
    got = spark.range(1).select(*[X.quantize(F.lit(x)) for x in values]).first()
    assert list(got) == [1, 0, -5000, 10000, -10000, 1235, 0]
    assert spark.range(1).select(X.dequantize(F.lit(-5000))).first()[0] == -0.5


def test_distances(spark):
    lit = lambda *x: [F.lit(v) for v in x]
    # the sentinel -1 is an ordinary coordinate
    assert spark.range(1).select(X.squared_distance(lit(-10000, -10000), lit(5000, 5000))).first()[0] == 2 * 15000**2
    assert spark.range(1).select(X.squared_distance(lit(*[10000] * 64), lit(*[-10000] * 64))).first()[0] == 64 * 20000**2
    assert spark.range(1).select(X.box_distance(lit(5, 0, 9), lit(0, 1, 0), lit(9, 3, 7))).first()[0] == 1 + 4


def test_generated_methods_are_compiled(spark, capsys):
    """The JVM never compiles a method of more than 8,000 bytes: no stage from the tables to quantized vectors has one."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        fixtures.vectors(spark, SF).explain("codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000
