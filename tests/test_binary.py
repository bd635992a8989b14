"""Binary references: written, read, and refused where they are damaged."""

from __future__ import annotations

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.constants import Q
from tessera.sources import binary

from .test_search import table


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(11)
    x, fraud = rng.integers(-10000, 10001, (700, 14)), rng.integers(0, 2, 700)
    return x, fraud, table(spark, x, "ref_id", fraud)


def told(df):
    return [tuple(r) for r in df.select("ref_id", *Q, "fraud").orderBy("ref_id").collect()]


def test_plain_round_trip(spark, rows, tmp_path, monkeypatch):
    x, fraud, df = rows
    want = [(i, *map(int, v), int(f)) for i, (v, f) in enumerate(zip(x, fraud, strict=True))]
    for files in (1, 3):
        path = f"file://{tmp_path}/plain{files}"
        binary.write(df, path, files)
        names = sorted(os.listdir(tmp_path / f"plain{files}"))
        assert names == [f"part-{i:06d}.bin" for i in range(files)]
        assert told(binary.read(spark, path)) == want
        assert binary.read(spark, path).where("cluster_id is not null").count() == 0
    # the bytes are those of the format
    raw = (tmp_path / "plain1" / "part-000000.bin").read_bytes()
    assert struct.unpack("<4siiiqii", raw[:32]) == (b"RIN1", 1, 14, 10000, 700, 0, 0)
    assert np.frombuffer(raw[32 : 32 + 700 * 28], "<i2").reshape(700, 14).tolist() == x.tolist() and list(raw[32 + 700 * 28 :]) == fraud.tolist()
    few = spark.read.format(binary.NAME).option("partrows", 64).load(f"file://{tmp_path}/plain1")
    assert few.rdd.getNumPartitions() == 11 and told(few) == want
    with pytest.raises(Exception, match="FileExists"):
        binary.write(df, f"file://{tmp_path}/plain1", 1)
    binary.write(df.where("ref_id < 5"), f"file://{tmp_path}/plain1", 1, mode="overwrite")
    assert told(binary.read(spark, f"file://{tmp_path}/plain1")) == want[:5]
    binary.write(df.where("false"), f"file://{tmp_path}/none", 1)
    assert told(binary.read(spark, f"file://{tmp_path}/none")) == []


def test_clustered_round_trip(spark, rows, tmp_path):
    x, fraud, df = rows
    assigned = df.withColumn("cluster_id", F.col("ref_id") % 7 * F.when(F.col("ref_id") % 7 == 3, 0).otherwise(1))  # cluster 3 is empty
    centroids = spark.createDataFrame([(i, *[i * 100 - 300] * 14) for i in range(7)], ", ".join(["cluster_id bigint", *(f"{q} int" for q in Q)]))
    want = sorted((tuple(map(int, v)), int(f), 0 if i % 7 == 3 else i % 7) for i, (v, f) in enumerate(zip(x, fraud, strict=True)))
    for files in (1, 4):
        path = f"file://{tmp_path}/clustered{files}"
        binary.write_clustered(assigned, centroids, path, files)
        got = binary.read(spark, path)
        assert sorted((tuple(r[q] for q in Q), r.fraud, r.cluster_id) for r in got.collect()) == want
        assert sorted(map(tuple, binary.read_centroids(spark, path).collect())) == sorted(map(tuple, centroids.collect()))
        few = binary.read(spark, path, clusters=[2, 3, 6])
        assert sorted((tuple(r[q] for q in Q), r.fraud, r.cluster_id) for r in few.collect()) == [w for w in want if w[2] in (2, 6)]
    raw = (tmp_path / "clustered1" / "part-000000.bin").read_bytes()
    assert struct.unpack("<4siiiqii", raw[:32]) == (b"RIN1", 2, 14, 10000, 700, 7, 0)
    assert np.frombuffer(raw[32 + 7 * 28 : 32 + 7 * 28 + 32], "<i4").tolist() == [0, 200, 300, 400, 400, 500, 600, 700]
    with pytest.raises(ValueError, match="numbered"):
        binary.write_clustered(assigned, centroids.where("cluster_id > 0"), f"file://{tmp_path}/bad", 1)


@pytest.mark.parametrize("damage,match", [
    (lambda b: b[:20], "small"), (lambda b: b"XXXX" + b[4:], "begin"), (lambda b: b[:4] + struct.pack("<i", 3) + b[8:], "version"), (lambda b: b[:8] + struct.pack("<i", 13) + b[12:], "dimensions"),
    (lambda b: b[:12] + struct.pack("<i", 1) + b[16:], "scale"), (lambda b: b[:16] + struct.pack("<q", -1) + b[24:], "rows"), (lambda b: b[:-1], "bytes"), (lambda b: b[:24] + struct.pack("<i", -2) + b[28:], "clusters"),
    (lambda b: b[: 32 + 56] + struct.pack("<iii", 0, 9, 2) + b[32 + 56 + 12 :], "beginnings"), (lambda b: b[: 32 + 56] + struct.pack("<iii", 1, 1, 3) + b[32 + 56 + 12 :], "beginnings"),
])
def test_damaged_files(spark, tmp_path, damage, match):
    whole = struct.pack("<4siiiqii", b"RIN1", 2, 14, 10000, 3, 2, 0) + np.zeros(28, "<i2").tobytes() + struct.pack("<iii", 0, 1, 3) + np.arange(42, dtype="<i2").tobytes() + bytes([1, 0, 1])
    (tmp_path / "a.bin").write_bytes(whole)
    got = binary.read(spark, f"file://{tmp_path}/a.bin").orderBy("ref_id").collect()
    assert [(r.q0, r.q13, r.fraud, r.cluster_id) for r in got] == [(0, 13, 1, 0), (14, 27, 0, 1), (28, 41, 1, 1)]
    (tmp_path / "a.bin").write_bytes(damage(whole))
    with pytest.raises(ValueError, match=match):
        binary.read(spark, f"file://{tmp_path}/a.bin")
