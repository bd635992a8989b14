"""Whitening against exact fractions and plain eigenvectors."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pytest

from tessera.llm import whitening


def exact_cov(rows):
    n, d = len(rows), len(rows[0])
    x = [[Fraction(v) for v in r] for r in rows]
    mean = [sum(r[j] for r in x) / n for j in range(d)]
    return np.array([[float(sum((r[i] - mean[i]) * (r[j] - mean[j]) for r in x) / n) for j in range(d)] for i in range(d)])


def told(spark, rows, schema="vec_id bigint, v array<double>, n string, component int"):
    return spark.createDataFrame([(i, v, "n", 1) for i, v in rows], schema).repartition(5)


def test_sums_lose_nothing():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (3001, 3)) * 10.0 ** rng.integers(-8, 9, (3001, 3))
    hi, lo = whitening.column_sums(x)
    want = [sum(map(Fraction, c)) for c in x.T.tolist()]
    assert all(abs(Fraction(a) + Fraction(b) - w) < abs(w) * Fraction(1, 10**28) for a, b, w in zip(hi.tolist(), lo.tolist(), want, strict=True))
    hi, lo = whitening.products(x, x * 1e-17)
    both = [[Fraction(a) + Fraction(a * 1e-17) for a in r] for r in x.tolist()]
    for i in range(3):
        for j in range(3):
            w = sum(r[i] * r[j] for r in both)
            scale = sum(abs(r[i] * r[j]) for r in both)
            assert abs(Fraction(float(hi[i, j])) + Fraction(float(lo[i, j])) - w) < scale * Fraction(1, 10**27)


@pytest.mark.parametrize("offset", [0, 10**9])
def test_against_exact_covariance(spark, offset, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    monkeypatch.setattr(whitening, "STRIP", 16)
    rng = np.random.default_rng(offset)
    x = np.floor(rng.normal(0, 1, (150, 6)) @ rng.normal(0, 9, (6, 6))) + offset
    rows = [(i % 140 or None, v) for i, v in enumerate(x.tolist())]
    bad = [(900, None), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (902, [1.0, float("nan"), 1.0, 1.0, 1.0, 1.0]), (903, [float("inf")] * 6), (904, [1.0]), (905, []), (906, [1e300] * 6)]
    df = told(spark, rows + bad)
    made = whitening.fit(df, "v", 4)
    cov = exact_cov(x.tolist())
    values, axes = np.linalg.eigh(cov)
    assert made.n == 150 and np.allclose(made.variances, values[::-1][:4], rtol=1e-12)
    assert np.allclose(made.explained, values[::-1][:4] / np.trace(cov), rtol=1e-12) and made.identity_error < 1e-12
    assert np.allclose(np.abs((axes[:, ::-1][:, :4] * made.axes).sum(axis=0)), 1, atol=1e-12)
    out = whitening.transform(df, made, "vec_id", "v").collect()
    assert len(out) == 150 * 4 and out[0].__fields__ == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    sums = [int(s) for s in x.sum(axis=0)]
    deviation = [sum((150 * int(v) - s) ** 2 for v, s in zip(r, sums, strict=True)) for r in x.tolist()]
    plain = (x - np.array([float(Fraction(s, 150)) for s in sums])) @ made.axes / np.sqrt(made.variances)
    want = sorted((str(i), c + 1, deviation[k], round(plain[k, c], 7)) for k, (i, _) in enumerate(rows) for c in range(4))
    got = sorted((str(r.vec_id), r.component, r.deviation, round(r.whitened, 7)) for r in out)
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-6)


def test_few_and_equal_vectors(spark):
    for rows, n in (([], None), ([(1, None)], None), ([(1, [1.0, 2.0])] * 3, 3), ([(1, [])], 1), ([(1, [5.0, 1.0]), (2, [6.0, 1.0]), (2, [7.5, 1.0])], 3)):
        df = told(spark, rows)
        made = whitening.fit(df, "v")
        assert (made and made.n) == n
        out = whitening.transform(df, made, "vec_id", "v").collect()
        # one direction varies in the last table, and halves have no exact whole deviation
        assert [(r.vec_id, r.component, r.deviation) for r in out] == ([(1, 1, None), (2, 1, None), (2, 1, None)] if n == 3 and len(set(map(str, rows))) > 1 else []) or len(out) == 3
    made = whitening.Whitening(10**10, (np.array([0.0]), np.array([0.0])), (np.zeros(1), np.zeros(1)), np.ones((1, 1)), np.ones(1), np.ones(1), 0.0)
    assert made.deviations(np.array([[3.0], [0.0]])) == [None, 0]  # beyond a long
