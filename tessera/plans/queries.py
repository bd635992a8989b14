"""The registered queries of the scoring engine."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.constants import MCC_RISK, Q, V
from tessera.functions.features import mcc_risk, vectorize
from tessera.functions.vectors import box_distance, dequantize, squared_distance
from tessera.operators import cells, ivf, knn
from tessera.operators.tiles import Counters, Tiles, as_tiles
from tessera.operators.vote import respond, vote
from tessera.plans import evaluate, fixtures, index
from tessera.plans.oracle import BASE, BUDGETS, CAP, CLUSTERS, DEPTH, EARLY, EPSILON, GOLD, MOST, PROBES, REFINED, ROUNDS, SLOW, SOFT, SPAN, STOP, VISITS
from tessera.plans.scorers import Brute, Scorer, Stub, VectorizeOnly, load
from tessera.plans.storage import kept, shared_dir
from tessera.sources import binary
from tessera.sources import references as R
from tessera.sources import requests as S

#: Order numbers of one labelled corpus.
CORPUS_ORDERS = 4_000
_NEIGHBOURS = ("qid", "ref_id", "d2", "fraud", "rank")


def _utc(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Queries and references, written once, as an engine has its index before it is asked."""
    _utc(spark)
    return fixtures.split(kept(fixtures.vectors(spark, sf_dir)))


def vectorize_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    _utc(spark)
    return vectorize(fixtures.transactions(spark, sf_dir), keep=("ok",)).select("ok", *V)


def quantize_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    _utc(spark)
    return fixtures.vectors(spark, sf_dir)


def dequantize_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantize_all(spark, sf_dir).select("ok", *[dequantize(F.col(q)).alias(q) for q in Q])


def mcc_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = fixtures.transactions(spark, sf_dir)
    code = F.array_position(F.array(*[F.lit(c) for c in fixtures.CODES]), F.col("merchant.mcc")) - 1
    joined = tx.join(F.broadcast(S.risks(spark)), F.col("merchant.mcc") == F.col("mcc"), "left")  # ten rows
    same = F.coalesce("risk", F.lit(0.5)) == mcc_risk(F.col("merchant.mcc"))
    return joined.where(same).groupBy(code.alias("code")).agg(F.count("*").alias("n"), F.min(mcc_risk(F.col("merchant.mcc"))).alias("risk"))


def parse_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    _utc(spark)
    bodies = S.to_body(fixtures.transactions(spark, sf_dir), keep=("ok",))
    t, c, m, e, z = (F.col(x) for x in ("transaction", "customer", "merchant", "terminal", "last_transaction"))
    return S.valid(S.parse(bodies, keep=("ok",))).select(
        "ok", t["amount"].alias("amount"), t["installments"].alias("installments"), F.unix_seconds(t["requested_at"]).alias("requested_at"),
        c["avg_amount"].alias("avg_amount"), c["tx_count_24h"].alias("tx_count_24h"), F.size(c["known_merchants"]).alias("n_known"),
        m["id"].alias("merchant"), m["avg_amount"].alias("merchant_avg"), e["is_online"].alias("is_online"), e["card_present"].alias("card_present"),
        e["km_from_home"].alias("km_from_home"), F.unix_seconds(z["timestamp"]).alias("last_at"), z["km_from_current"].alias("last_km"),
    )


def parse_reject_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies are broken in a way that their order's number names."""
    _utc(spark)
    bodies = S.to_body(fixtures.transactions(spark, sf_dir), keep=("ok",))
    kind, body = F.col("ok") % 13, F.col("body")
    drop = lambda pattern: F.regexp_replace(body, pattern, "")
    broken = (
        F.when(kind == 1, drop(r'"id":"tx-\d+",')).when(kind == 2, drop(r',"requested_at":"[^"]*"')).when(kind == 3, F.regexp_replace(body, r'"merchant":\{[^}]*\}', '"merchant":null'))
        .when(kind == 4, F.concat(F.lit("["), body)).when(kind == 5, F.regexp_replace(body, r'"requested_at":"[^"]*"', '"requested_at":"soon"')).when(kind == 6, drop(r'"transaction":\{[^}]*\},'))
        .otherwise(body)
    )
    return S.rejected(S.parse(bodies.select("ok", broken.alias("body")), keep=("ok",)), keep=("ok",))


def route_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    path = F.when(F.col("event_type").isin("view", "click"), "/fraud-score").otherwise("/other")
    method = F.when(F.col("event_id") % 3 == 0, "GET").otherwise("POST")
    return events.select("event_id", S.route(method, path, F.col("event_id") % 5000 + 4000).alias("status"))


def squared(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kept(quantize_all(spark, sf_dir))
    other = rows.select((F.col("ok") - 1).alias("ok"), F.col("ok").alias("ref_id"), *[F.col(q).alias(f"r_{q}") for q in Q])
    return rows.join(other, "ok").select(F.col("ok").alias("qid"), "ref_id", squared_distance([F.col(q) for q in Q], [F.col(f"r_{q}") for q in Q]).alias("d2"))


def knn_brute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.knn(*_sides(spark, sf_dir)).select(*_NEIGHBOURS)


def knn_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.knn(*_sides(spark, sf_dir), k=1).select("qid", "ref_id", "d2")


def knn_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, references, names = fixtures.embeddings(spark, sf_dir)
    return knn.knn(queries, references, vector=names).select(*_NEIGHBOURS)


def score(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, references = _sides(spark, sf_dir)
    return vote(knn.knn(queries, references), references.count())


def http_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    return respond(score(spark, sf_dir)).select("qid", "http_frauds", "http_body")


def _built(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    queries, references = _sides(spark, sf_dir)
    centroids = index.lloyd(references, index.seeds(references, CLUSTERS), ROUNDS)
    return queries, centroids, ivf.assign(references, centroids)


def _opened(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, Tiles]:
    """The same with the clusters packed once."""
    queries, centroids, assigned = _built(spark, sf_dir)
    return queries, centroids, as_tiles(assigned)


def ivf_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(spark, sf_dir)[2].select(F.col("ref_id").alias("ok"), "cluster_id")


def ivf_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(spark, sf_dir)[1]


def ivf_cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, centroids, assigned = _built(spark, sf_dir)
    return ivf.cluster_sizes(assigned, centroids)


def ivf_cluster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivf.cluster_stats(ivf_cluster_sizes(spark, sf_dir))


def ivf_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, centroids, _ = _built(spark, sf_dir)
    return ivf.shortlist(queries, centroids, BASE)


def _ivf(base: int, most: int, cap: int | None = None) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: ivf.search(*_opened(spark, sf_dir), base=base, most=most, cap=cap).select(*_NEIGHBOURS)


def cells_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, references = _sides(spark, sf_dir)
    return cells.search(queries, kept(index.build_cells(references, 256))).select(*_NEIGHBOURS)


def _as_cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Queries, and the references with their clusters as cells."""
    queries, _, assigned = _built(spark, sf_dir)
    return queries, kept(assigned.withColumnRenamed("cluster_id", "cell_id"))


def cells_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of how many references a query meets in the exact search."""
    seen = cells.search(*_as_cells(spark, sf_dir), visits=True)
    return evaluate.percentiles(seen, "candidates", (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)))


def _exact(queries: DataFrame, references: DataFrame, n: int) -> DataFrame:
    return vote(knn.knn(queries, references), n).select("qid", F.col("approved").alias("expected_approved"))


def cells_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of searches that stop after some cells with the exact one; all of them are one scan."""
    queries, assigned = _as_cells(spark, sf_dir)
    opened = cells.opened(assigned)
    found = vote(cells.sweep(queries, opened, BUDGETS, by_cells=True), opened.count, keys=("setting",))
    told = found.withColumn("setting", F.concat(F.lit("cells="), F.col("setting").cast("string")))
    return evaluate.sweep(told, _exact(queries, assigned, opened.count))


def cells_refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search that stops after some visits, with the exact one for every vote: the whole range counts as the border here."""
    return cells.search_refined(*_as_cells(spark, sf_dir), REFINED, (0, 5)).select(*_NEIGHBOURS)


def _levels(spark: SparkSession, sf_dir: str, rule: str = "median") -> tuple[DataFrame, DataFrame]:
    """Queries, and the references in the cells of DEPTH levels of splits."""
    queries, references = _sides(spark, sf_dir)
    return queries, index.build_levels(references, DEPTH, rule)


def cells_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir)[1].select(F.col("ref_id").alias("ok"), "cell_id")


def cells_midpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir, "midpoint")[1].select(F.col("ref_id").alias("ok"), "cell_id")


def boxes_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact search on a written index with its tree of boxes, cut at the middle."""
    queries, assigned = _levels(spark, sf_dir, "midpoint")
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    index.save(path, assigned, "cells", shards=16)
    return cells.search(queries, index.load(spark, path)[1]).select(*_NEIGHBOURS)


def boxes_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each level of the tree, how many pairs of a query and a box were bounded, and how many pruned."""
    queries, assigned = _levels(spark, sf_dir)
    return cells.descent(queries, cells.opened(assigned, heap=True))


def search_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the exact search of all queries scans, sees and prunes, as observed while it runs."""
    queries, assigned = _levels(spark, sf_dir)
    counters = Counters()
    cells.search(queries, cells.opened(assigned, heap=True), counters=counters)
    told = counters.totals
    return spark.createDataFrame([tuple(told[x] for x in Counters.NAMES)], ", ".join(f"{x} bigint" for x in Counters.NAMES))


def _tuned(**knobs) -> Callable[[SparkSession, str], DataFrame]:
    """Votes of a search in rounds, and what it read."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        queries, assigned = _levels(spark, sf_dir)
        opened = cells.opened(assigned, heap=True)
        found, counters = cells.search_tuned(queries, opened, **knobs)
        return vote(found, opened.count).join(counters, "qid")

    return run


def visits_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budgets of visits: errors against the labels, decisions that differ from brute force on a sample of queries, and
    what was visited. All budgets are answered by one scan."""
    queries, assigned = _levels(spark, sf_dir)
    opened = cells.opened(assigned, heap=True)
    found = vote(cells.sweep(queries, opened, VISITS), opened.count, keys=("setting",))
    labelled = kept(found.join(queries.select("qid", (F.col("fraud") == 0).alias("expected_approved")), "qid"))
    errors = evaluate.confusion(labelled, keys=("setting",)).select("setting", "total", F.col("raw_errors").alias("errors"))
    sample = queries.orderBy(F.xxhash64("qid"), "qid").limit(GOLD)  # the sample's size is a parameter
    gold = vote(knn.knn(sample, assigned), opened.count).select("qid", F.col("frauds").alias("gold"))
    missed = labelled.join(gold, "qid").groupBy("setting").agg(F.count_if(F.col("frauds") != F.col("gold")).alias("mismatches"))
    spent = evaluate.percentiles(kept(cells.spent(queries, opened, VISITS)), "visits", (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)), ("setting",)).drop("n")
    return errors.join(missed, "setting").join(spent, "setting")


def cells_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.boxes(_built(spark, sf_dir)[2].withColumnRenamed("cluster_id", "cell_id"))


def box_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, _, assigned = _built(spark, sf_dir)
    boxes = cells.boxes(assigned.withColumnRenamed("cluster_id", "cell_id"))
    side = lambda p: [F.col(f"{p}_{q}") for q in Q]
    # one row a cluster, of which there are CLUSTERS
    return queries.crossJoin(F.broadcast(boxes)).select("qid", F.col("cell_id").alias("cluster_id"), box_distance([F.col(q) for q in Q], side("lo"), side("hi")).alias("bound"))


def index_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, references = _sides(spark, sf_dir)
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    index.save(path, index.build_cells(references, 64), "cells")
    meta, loaded, _ = index.load(spark, path)
    return vote(cells.search(queries, loaded), meta["count"])


def _streamed(spark: SparkSession, sf_dir: str, scorer: Callable[[DataFrame], Scorer], files: int) -> DataFrame:
    """Bodies in files, through a stream that takes one file a batch, to decisions."""
    from tessera.streaming import score as stream

    _utc(spark)
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    tx = fixtures.transactions(spark, sf_dir).where("ok % 10 = 0")
    S.to_body(tx).select("body").repartition(files).write.text(f"{root}/in")
    asked = scorer(_sides(spark, sf_dir)[1])
    query = stream.start(stream.bodies(spark, f"{root}/in", 1), asked, stream.to_parquet(f"{root}/out"), f"{root}/state", once=True)
    query.awaitTermination()
    asked.release()
    out = spark.read.parquet(f"{root}/out").where("error is null")
    return out.select(F.substring_index("id", "-", -1).cast("bigint").alias("qid"), "frauds", "fraud_score", "approved")


def stream_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream that is scored by brute force."""
    return _streamed(spark, sf_dir, Brute, 2)


def stream_preloaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of several batches, scored by an index that was written, opened once and is held by the executors."""

    def opened(references: DataFrame) -> Scorer:
        path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
        index.save(path, index.build_cells(references, 64), "cells", shards=16)
        return load(spark, path).preload()

    return _streamed(spark, sf_dir, opened, 3)


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = score(spark, sf_dir).withColumn("expected_approved", (F.col("qid") * 7919 + 13) % 100 >= 25)
    return evaluate.confusion(truth)


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.percentiles(spark.read.parquet(f"{sf_dir}/events.parquet"), "value")


def _probed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Votes (setting, qid, frauds, approved) of searches that probe PROBES clusters, from one scan, and the exact decisions."""
    queries, centroids, assigned = _built(spark, sf_dir)
    assigned = kept(assigned)
    tiles = as_tiles(assigned)
    found = kept(vote(ivf.sweep(queries, centroids, tiles, PROBES), tiles.count, keys=("setting",)))
    return found, kept(_exact(queries, assigned, tiles.count))


def load_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for each number of probes: its decisions against the exact ones, slow failures among its share of the events as
    errors, and the times of these events."""
    found, exact = _probed(spark, sf_dir)
    run = F.array_position(F.array(*map(F.lit, PROBES)), F.col("setting")) - 1
    scored = evaluate.confusion(found.join(exact, "qid").withColumn("run", run), keys=("run",)).select("run", "fp", "fn", F.col("total").alias("n"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("run", F.col("event_id") % len(PROBES))
    errors = events.groupBy("run").agg(F.count_if((F.col("event_type") == "error") & (F.col("value") > SLOW)).alias("errors"))
    times = evaluate.percentiles(events, "value", (("p99", 0.99),), ("run",)).select("run", "p99")
    return evaluate.report(scored.join(errors, "run").join(times, "run").select("run", "fp", "fn", "errors", "n", "p99"))


def nprobe_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed and adaptive numbers of probes against the exact search: all settings from one scan."""
    found, exact = _probed(spark, sf_dir)
    fixed = found.select(F.concat(F.lit("nprobe="), F.col("setting").cast("string")).alias("setting"), "qid", "approved")
    most = found.where(F.col("setting") == MOST).select("qid", F.col("approved").alias("wide"))
    decided = F.when(F.col("frauds").between(2, 4), F.col("wide")).otherwise(F.col("approved"))
    name = F.concat(F.lit("adaptive="), F.col("setting").cast("string"), F.lit(f"-{MOST}"))
    adaptive = found.where(F.col("setting") < MOST).join(most, "qid").select(name.alias("setting"), "qid", decided.alias("approved"))
    return evaluate.sweep(fixed.unionByName(adaptive), exact)


def corpus_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All transactions, written as labelled corpora of at most CORPUS_ORDERS entries and read back."""
    _utc(spark)
    bodies = S.to_body(fixtures.transactions(spark, sf_dir), keep=("ok",))
    entry = F.struct(F.col("body").alias("request"), ((F.col("ok") * 7919 + 13) % 100 >= 25).alias("expected_approved"))
    corpora = bodies.groupBy(F.floor(F.col("ok") / CORPUS_ORDERS).alias("part")).agg(F.collect_list(entry).alias("entries"))
    path = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    corpora.select(F.to_json(F.struct("entries")).alias("value")).write.text(path)
    read = S.valid(S.parse(R.read_corpus(spark, path, lines=True), keep=("expected_approved",)))
    return read.select(F.substring_index("id", "-", -1).cast("bigint").alias("ok"), "expected_approved")


def generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A synthetic request of every event's number, through JSON to vectors."""
    _utc(spark)
    numbers = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("n"))
    return vectorize(S.valid(S.parse(S.to_body(S.generate_of(numbers))))).select("id", *V)


def baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two baselines over all transactions."""
    _utc(spark)
    requests = fixtures.transactions(spark, sf_dir)
    runs = [(name, s.score(requests)) for name, s in (("stub", Stub()), ("vectorize", VectorizeOnly()))]
    both = [r.select(F.lit(name).alias("baseline"), "id", "frauds", "fraud_score", "approved", "status") for name, r in runs]
    return both[0].unionByName(both[1])


def score_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every query twice under one id: each row is scored by itself."""
    _utc(spark)
    _, references = _sides(spark, sf_dir)
    asked = fixtures.transactions(spark, sf_dir).where("ok % 10 = 0")  # the fixture's queries
    scored = Brute(references).score(asked.unionByName(asked))
    return scored.select(F.substring_index("id", "-", -1).cast("bigint").alias("qid"), "frauds", "fraud_score", "approved", "status")


def fail_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All transactions against no reference at all: nobody is lost, and all are denied."""
    _utc(spark)
    _, references = _sides(spark, sf_dir)
    scored = Brute(references.where("false")).score(fixtures.transactions(spark, sf_dir))
    return scored.select("id", "fraud_score", "approved", "status")


def references_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings of 14 leading dimensions as labelled references, written as gzipped JSON lines and read back."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    path = f"{shared_dir(spark)}/references-{uuid.uuid4().hex}"
    vector = F.transform(F.slice("embedding", 1, len(Q)), lambda x: x.cast("double"))
    told = table.select(vector.alias("vector"), F.when(F.col("label") >= 5, "fraud").otherwise("legit").alias("label"))
    told.write.option("compression", "gzip").json(path)
    return R.references(R.read_json(spark, path, lines=True)).groupBy(*Q, "fraud").agg(F.count("*").alias("n"))


def fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scorers that are found as indexes go missing, and their decisions on the fixture's queries."""
    queries, references = _sides(spark, sf_dir)
    root = f"{shared_dir(spark)}/fallback-{uuid.uuid4().hex}"
    index.save(f"{root}/cells", index.build_cells(references, 64), "cells")
    index.save(f"{root}/flat", references)
    runs = [("cells", load(spark, f"{root}/cells", f"{root}/flat")), ("flat", load(spark, f"{root}/none", f"{root}/flat")), ("stub", load(spark, f"{root}/none", f"{root}/no", f"{root}/no"))]
    out = [s.score_vectors(queries).select(F.lit(name).alias("found"), "qid", "frauds", "fraud_score", "approved") for name, s in runs]
    return out[0].unionByName(out[1]).unionByName(out[2])


def ivf_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole build from stated seeds, probed in part."""
    queries, references = _sides(spark, sf_dir)
    centroids, assigned = index.build_ivf(references, CLUSTERS, ROUNDS, start=index.seeds(references, CLUSTERS))
    return ivf.search(queries, centroids, assigned, base=BASE, most=BASE).select(*_NEIGHBOURS)


def ivf_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A written index with a folder for each cluster, of which a search reads those that are probed."""
    queries, centroids, assigned = _built(spark, sf_dir)
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    index.save(path, assigned, "ivf", centroids, shards=CLUSTERS)
    _, tiles, known = index.load(spark, path)
    return ivf.search(queries, known, tiles, base=BASE, most=MOST).select(*_NEIGHBOURS)


def binary_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All references as binary files and back."""
    _, references = _sides(spark, sf_dir)
    path = f"{shared_dir(spark)}/plain-{uuid.uuid4().hex}"
    binary.write(references, path)
    return binary.read(spark, path).groupBy(*Q, "fraud").agg(F.count("*").alias("n"))


def binary_clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All clusters as binary files with centroids and back, with the rows of every third cluster read apart."""
    _, centroids, assigned = _built(spark, sf_dir)
    path = f"{shared_dir(spark)}/clustered-{uuid.uuid4().hex}"
    binary.write_clustered(assigned, centroids, path)
    known = binary.read_centroids(spark, path).select("cluster_id", F.hash(*Q).alias("h"))
    same = centroids.select("cluster_id", F.hash(*Q).alias("h"))
    rows = binary.read(spark, path).groupBy("cluster_id").agg(F.count("*").alias("n"), F.sum("fraud").alias("frauds"), *[F.sum(q).alias(q) for q in Q])
    few = binary.read(spark, path, range(0, CLUSTERS, 3)).groupBy("cluster_id").agg(F.count("*").alias("n_apart"))
    return rows.join(known.join(same, ["cluster_id", "h"]).drop("h"), "cluster_id").join(few, "cluster_id", "left")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "vectorize": vectorize_all, "quantize": quantize_all, "dequantize": dequantize_all, "mcc_lookup": mcc_lookup,
    "parse_valid": parse_valid, "parse_reject_reason": parse_reject_reason, "route_status": route_status, "squared_distance": squared,
    "knn_brute": knn_brute, "knn_top1": knn_top1, "knn_embeddings": knn_embeddings, "score": score, "http_response": http_response,
    "ivf_assign": ivf_assign, "ivf_centroids": ivf_centroids, "ivf_cluster_sizes": ivf_cluster_sizes, "ivf_cluster_stats": ivf_cluster_stats,
    "ivf_shortlist": ivf_shortlist, "ivf_fixed": _ivf(BASE, BASE), "ivf_adaptive": _ivf(BASE, MOST), "ivf_scancap": _ivf(BASE, BASE, CAP),
    "ivf_full_probe": _ivf(CLUSTERS, CLUSTERS), "cells_knn": cells_knn, "cells_bbox": cells_bbox, "box_distance": box_bounds,
    "cells_refined": cells_refined, "cells_visits": cells_visits, "cells_budget": cells_budget, "index_roundtrip": index_roundtrip, "stream_score": stream_score,
    "confusion": confusion, "latency_percentiles": latency_percentiles, "load_report": load_report, "nprobe_sweep": nprobe_sweep,
    "score_repeats": score_repeats, "fail_safe": fail_safe, "references_read": references_read, "fallback": fallback, "ivf_build": ivf_build,
    "cells_levels": cells_levels, "cells_midpoint": cells_midpoint, "boxes_knn": boxes_knn, "boxes_descent": boxes_descent, "search_counters": search_counters,
    "boxes_early": _tuned(early_d2=EARLY), "boxes_relaxed": _tuned(epsilon=EPSILON, soft=SOFT, span=SPAN), "boxes_stopped": _tuned(most_visits=STOP), "boxes_rounds": _tuned(),
    "visits_sweep": visits_sweep, "stream_preloaded": stream_preloaded, "ivf_pruned": ivf_pruned, "binary_plain": binary_plain, "binary_clustered": binary_clustered,
    "corpus_scan": corpus_scan, "generated": generated, "baselines": baselines,
}

assert len(fixtures.CODES) == len(S.GENERATED_MCCS) == len(MCC_RISK) + 2
