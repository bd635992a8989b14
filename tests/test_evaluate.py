from __future__ import annotations

import pytest

from tessera.plans import evaluate

# Counts and times of runs, and the scores that they get.
GOLDEN = [
    ((0, 0, 0, 1.0), (3000, 3000, 6000)),
    ((5, 5, 0, 3.0), (2522.88, 2001.27, 4524.15)),
    ((0, 0, 0, 100.0), (1000, 3000, 4000)),
    ((30, 20, 0, 10.0), (2000, 1157.02, 3157.02)),
    ((100, 50, 0, 300.0), (522.88, 581.13, 1104.01)),
    ((500, 250, 0, 200.0), (698.97, -327.12, 371.85)),
    ((500, 300, 0, 10.0), (2000, -3000, -1000)),
    ((0, 0, 5000, 60000.0), (-3000, -3000, -6000)),
]


def test_report(spark):
    rows = [(i, fp, fn, err, 5000, p99) for i, ((fp, fn, err, p99), _) in enumerate(GOLDEN)]
    got = evaluate.report(spark.createDataFrame(rows, "run int, fp bigint, fn bigint, errors bigint, n bigint, p99 double")).orderBy("run").collect()
    for r, (_, want) in zip(got, GOLDEN, strict=True):
        assert (r.p99_score, r.detection_score, r.final_score) == pytest.approx(want, abs=0.011)
    assert got[6].rate_part is None and got[6].absolute_part is None


def test_confusion(spark):
    rows = [(False, False)] * 4 + [(True, True)] * 3 + [(True, False)] * 2 + [(False, True)]
    r = evaluate.confusion(spark.createDataFrame(rows, "expected_approved boolean, approved boolean")).first()
    assert (r.tp, r.tn, r.fp, r.fn, r.accuracy, r.weighted_e, r.raw_errors) == (4, 3, 2, 1, 0.7, 5, 3)
    assert evaluate.confusion(spark.createDataFrame([], "expected_approved boolean, approved boolean")).first().accuracy is None


def test_percentiles_occur(spark):
    r = evaluate.percentiles(spark.range(1, 101).withColumnRenamed("id", "x"), "x").first()
    assert (r.n, r.p50, r.p90, r.p99, r.p999, r.most) == (100, 50, 90, 99, 100, 100)
