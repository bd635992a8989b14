"""Indexes that are written, pruned, opened once and held."""

from __future__ import annotations

import socket
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import cells, ivf, kernel, knn, splits, tiles
from tessera.operators.topk import TopK
from tessera.plans import index, scorers
from tessera.plans.storage import kept, remove, scratch, shared_dir
from tessera.sources import requests as S
from tessera.streaming import score as stream

from .test_search import brute, table, told


@pytest.fixture(scope="module")
def lumps(spark):
    """Nine tenths of the references in one cluster."""
    rng = np.random.default_rng(5)
    r = np.r_[rng.normal(0, 900, (1800, 14)), rng.normal(6000, 500, (200, 14))].astype(int).clip(-10000, 10000)
    q = np.r_[rng.normal(0, 900, (30, 14)), rng.normal(6000, 500, (10, 14))].astype(int)
    references = kept(table(spark, r, "ref_id", rng.integers(0, 2, 2000)))
    centroids = spark.createDataFrame([(0, *[0] * 14), (1, *[5800] * 14), (2, *[6200] * 14), (3, *[-9000] * 14)], ", ".join(["cluster_id bigint", *(f"q{i} int" for i in range(14))]))
    return q, r, kept(table(spark, q, "qid")), references, centroids


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_cluster_is_dealt(spark, lumps):
    q, r, queries, references, centroids = lumps
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a small table would be put together again
    packed = kept(tiles.pack(ivf.assign(references, centroids), rows=64))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    hot = packed.where("grp = 0").select(F.col("seq").bitwiseAND(F.lit(-1 << 32)).alias("part")).distinct().count()
    assert hot >= 2 and packed.agg(F.max("n")).first()[0] <= 64 and tiles.sizes(packed)[0] == 1800
    ordered = [np.frombuffer(x.ids, np.int64).tolist() for x in packed.where("grp = 0").orderBy("seq").collect()]
    assert sum(ordered, []) == sorted(sum(ordered, []))
    opened = tiles.Tiles(packed)
    assert told(ivf.search(queries, centroids, opened, 4, 4), len(q)) == brute(q, r, 5)
    # takes go through tiles that lie in several tasks
    capped = ivf.search(queries, centroids, opened, 1, 1, cap=700)
    inside = np.flatnonzero((ivf._distances(r.astype(float), ivf.centroid_matrix(centroids)[1]).argmin(axis=1)) == 0)[:700]
    assert told(capped, len(q))[0] == [(int(inside[j]), d) for j, d in brute(q[:1], r[inside], 5)[0]]


def test_blocks_that_are_not_broadcast(spark, lumps):
    q, r, queries, references, centroids = lumps
    opened = tiles.as_tiles(ivf.assign(references, centroids))
    asked = tiles.blocks(queries, ivf._few(centroids, 1, 4, None, None, [f"q{i}" for i in range(14)]))
    both = [told(kernel.best(tiles.scan(opened, asked, 14, 5, broadcast_bytes=b), 5), len(q)) for b in (0, 1 << 20)]
    assert both[0] == both[1] == brute(q, r, 5)


def test_pruned_reads(spark, lumps):
    q, r, queries, references, centroids = lumps
    path = f"{shared_dir(spark)}/pruned-index"
    index.save(path, ivf.assign(references, centroids), "ivf", centroids, shards=4)
    meta, opened, known = index.load(spark, path)
    assert (meta["count"], meta["clusters"]) == (2000, 4)
    few = queries.where("qid >= 30")  # near clusters 1 and 2 alone
    found = tiles.scan(opened, tiles.blocks(few, ivf._few(known, 1, 2, None, None, [f"q{i}" for i in range(14)])), 14, 5)
    text = plan(found)
    assert "PartitionFilters" in text and "Exchange" not in text
    read = found._jdf.queryExecution().optimizedPlan().toString()
    assert "shard" in text and "0" not in read.split("shard", 1)[1].split("IN", 1)[1].split(")", 1)[0].replace("(", "").split(",")
    assert told(kernel.best(found, 5).withColumn("qid", F.col("qid") - 30), 10) == brute(q[30:], r, 5)
    with pytest.raises(Exception, match="exists"):
        index.save(path, ivf.assign(references, centroids), "ivf", centroids)


def test_cells_index(spark, lumps):
    q, r, queries, references, _ = lumps
    path = f"{shared_dir(spark)}/cells-index"
    assigned = splits.split(references, 4, "midpoint")
    index.save(path, assigned, "cells", shards=5)
    meta, opened, _ = index.load(spark, path)
    assert meta["clusters"] == 16 and opened.count == 2000
    assert told(cells.search(queries, opened), len(q)) == brute(q, r, 5)
    found, counters = cells.search_tuned(queries, opened)
    assert told(found, len(q)) == brute(q, r, 5)
    most = counters.agg(F.max("visits"), F.max("cells"), F.min("cells")).first()
    assert most[0] <= 2000 and most[1] <= 16 and most[2] >= 1
    stopped, _ = cells.search_tuned(queries, opened, early_d2=1 << 40)
    assert told(stopped, len(q)) == told(cells.search_budget(queries, opened, visits=5), len(q))
    spark.read.parquet(f"{path}/nodes").where("node > 0").write.parquet(f"{path}/less")
    remove(spark, f"{path}/nodes")
    spark.read.parquet(f"{path}/less").write.parquet(f"{path}/nodes")
    with pytest.raises(ValueError, match="tree"):
        index.load(spark, path)


def test_k_is_checked_everywhere(spark, lumps):
    _, _, queries, references, centroids = lumps
    for k in (0, 6):
        for call in (lambda k=k: ivf.search(queries, centroids, references, k=k), lambda k=k: cells.search(queries, references, k=k), lambda k=k: cells.search_budget(queries, references, 1, k=k), lambda k=k: cells.search_tuned(queries, references, k=k), lambda k=k: knn.knn(queries, references, k=k)):
            with pytest.raises(ValueError):
                call()


def test_few_rows_reach_the_window(spark, lumps):
    """However many tiles a task compares, it hands on at most k rows a query."""
    q, r, queries, references, centroids = lumps
    packed = kept(tiles.pack(ivf.assign(references, centroids), rows=16))
    asked = tiles.blocks(queries, ivf._few(centroids, 1, 4, None, None, [f"q{i}" for i in range(14)]))
    found = tiles.scan(tiles.Tiles(packed), asked, 14, 5).withColumn("task", F.spark_partition_id())
    assert packed.count() > 100 and found.groupBy("qid", "task").count().agg(F.max("count")).first()[0] <= 5
    held = TopK(2, steps=True)
    list(held.add(*(np.array(c) for c in ([1, 1, 1, 1], [4, 3, 2, 1], [7, 7, 7, 9], [0, 1, 0, 1])), np.array([0, 0, 0, 1])))
    rows = next(held.rows()).to_pylist()
    assert [(x["qid"], x["ref_id"], x["step"]) for x in rows] == [(1, 2, 0), (1, 3, 0), (1, 1, 1)]


def test_held_index_answers_a_stream(spark, lumps, tmp_path):
    """Batches after the first don't need the index's files, and no batch leaves anything in the shared folder."""
    _, _, _, references, centroids = lumps
    root = f"{shared_dir(spark)}/held"
    index.save(f"{root}/ivf", ivf.assign(references, centroids), "ivf", centroids)
    index.save(f"{root}/cells", splits.split(references, 3), "cells")
    index.save(f"{root}/flat", references)
    requests = kept(S.generate(spark, 45))
    S.to_body(requests).select("body").repartition(3).write.text(f"file://{tmp_path}/in")
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tessera-core")
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for name in ("ivf", "cells", "flat"):
        scorer = scorers.load(spark, f"{root}/{name}")
        want = sorted(map(tuple, scorer.score(requests).select("id", "frauds", "approved").collect()))
        scorer.preload()
        remove(spark, f"{root}/{name}")
        before, counted = len(files.listStatus(at)), []
        query = stream.start(stream.bodies(spark, f"file://{tmp_path}/in", 1), scorer, stream.to_parquet(f"file://{tmp_path}/{name}"), f"file://{tmp_path}/state-{name}", once=True, report=lambda n, told, c=counted: c.append(told))
        query.awaitTermination()
        assert len([p for p in query.recentProgress if p["numInputRows"]]) == 3 and len(files.listStatus(at)) == before
        got = spark.read.parquet(f"file://{tmp_path}/{name}").select("id", "frauds", "approved")
        assert sorted(map(tuple, got.collect())) == want and len(want) == 45
        assert [c["candidates"] >= c["pairs"] > 0 for c in counted] == ([] if name == "flat" else [True] * 3)
        assert all((c["seen"] > c["pruned"] >= 0) == (name == "cells") for c in counted)
        scorer.release()


def test_requests_from_a_socket(spark, lumps, tmp_path):
    _, _, _, references, _ = lumps
    lines = [r.body for r in S.to_body(S.generate(spark, 20)).collect()]
    with socket.create_server(("127.0.0.1", 0)) as server:

        def serve() -> None:
            peer, _ = server.accept()
            with peer:
                peer.sendall("".join(x + "\n" for x in [*lines, "nonsense"]).encode())
                closed.wait(60)

        closed = threading.Event()
        threading.Thread(target=serve, daemon=True).start()
        query = stream.start(stream.socket_bodies(spark, "127.0.0.1", server.getsockname()[1]), scorers.Brute(references), stream.to_parquet(f"file://{tmp_path}/out"), f"file://{tmp_path}/state")
        end = time.time() + 60
        while sum(p["numInputRows"] for p in query.recentProgress) < 21 and time.time() < end:
            time.sleep(0.2)
        query.stop()
        closed.set()
    got = spark.read.parquet(f"file://{tmp_path}/out")
    assert got.where("error is null").count() == 20 and got.where("error = 'bad_json'").count() == 1


def test_scratch_is_deleted_after_errors(spark):
    with pytest.raises(RuntimeError), scratch():
        inner = kept(spark.range(3))
        raise RuntimeError
    with pytest.raises(Exception, match="exist|found|FAILED_READ"):
        inner.collect()


def test_requests_are_parsed_once(spark):
    bodies = S.to_body(S.generate(spark, 5))
    for df in (S.valid(S.parse(bodies)), S.rejected(S.parse(bodies)), S.parse(bodies)):
        assert plan(df).count("from_json") == 1
