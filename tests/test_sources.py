from __future__ import annotations

import gzip
import json

import pytest

from tessera.sources import references as R
from tessera.sources import requests as S

from .test_features import LEGIT


def errors(spark, *bodies):
    rows = spark.createDataFrame(list(enumerate(bodies)), "n int, body string")
    return [r["error"] for r in S.parse(rows, keep=("n",)).orderBy("n").collect()]


def test_refusals(spark):
    drop = lambda name: json.dumps({k: v for k, v in json.loads(LEGIT).items() if k != name})
    assert errors(spark, LEGIT, drop("id"), drop("transaction"), drop("customer"), drop("merchant"), drop("terminal"), drop("last_transaction")) == [None, "missing_id", "missing_transaction", "missing_customer", "missing_merchant", "missing_terminal", None]
    assert errors(spark, None, "", "[]", "7", "{", "nonsense", "[" + LEGIT + "]") == ["bad_json"] * 7
    assert errors(spark, LEGIT.replace("2026-03-11T18:45:53Z", "soon")) == ["bad_requested_at"]
    assert errors(spark, LEGIT.replace(',"requested_at":"2026-03-11T18:45:53Z"', "")) == ["missing_requested_at"]
    assert errors(spark, LEGIT.replace('"last_transaction":null', '"last_transaction":{"timestamp":"x"}')) == ["bad_last_timestamp"]
    assert errors(spark, LEGIT[:-1] + ',"more":"' + "x" * 8192 + '"}') == ["too_large"]


def test_lenient_values(spark):
    body = LEGIT.replace("41.12", '"41.12"').replace('"installments":2', '"installments":"two"').replace('"is_online":false', '"is_online":"maybe"').replace('"id":"a"', '"id":7,"unknown":{"x":[1]}')
    row = S.parse(spark.createDataFrame([(body,)], "body string")).first()
    assert (row.error, row.id, row.transaction.amount, row.transaction.installments, row.terminal.is_online) == (None, "7", 41.12, 0, False)


def test_references(spark, tmp_path):
    rows = [{"vector": [0.5, -1.0], "label": "fraud"}, {"vector": [0.12345, 3.0], "label": "odd"}]
    (tmp_path / "r.json").write_text(json.dumps(rows))
    with gzip.open(tmp_path / "r.json.gz", "wt") as f:
        json.dump(rows, f)
    for name in ("r.json", "r.json.gz"):
        got = R.references(R.read_json(spark, f"file://{tmp_path}/{name}"), dims=2).orderBy("ref_id").collect()
        assert [(r.q0, r.q1, r.fraud) for r in got] == [(5000, -10000, 1), (1235, 10000, 0)]


@pytest.mark.parametrize("bad", [[1.0], None, []])
def test_bad_vectors(spark, bad):
    rows = spark.createDataFrame([(bad, "fraud")], "vector array<double>, label string")
    with pytest.raises(Exception, match="vector"):
        R.references(rows, dims=2).collect()


def test_corpus(spark, tmp_path):
    entries = [{"request": json.loads(LEGIT), "expected_approved": i % 2 == 0, "note": "x"} for i in range(3)]
    (tmp_path / "c.json").write_text(json.dumps({"entries": entries, "stats": {"total": 3}}))
    got = R.read_corpus(spark, f"file://{tmp_path}/c.json", limit=2)
    parsed = S.valid(S.parse(got, keep=("entry", "expected_approved"))).orderBy("entry").collect()
    assert [(r.entry, r.expected_approved, r.id) for r in parsed] == [(0, True, "a"), (1, False, "a")]


def test_generator(spark):
    a, b = S.generate(spark, 400), S.generate(spark.newSession(), 400)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert 20 < a.where("last_transaction is null").count() < 90
    assert errors(spark, *[r.body for r in S.to_body(a).limit(50).collect()]) == [None] * 50
