"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles.

Words are runs of digits and letters, lower-cased in A-Z; shingles are five words (a text of fewer is one shingle). A
shingle's weight in a text is its count there times its IDF, IDF_FLOOR + (1 - IDF_FLOOR) * log(N / df) / log(N) with df
and N over all documents (df in 255 steps, exact up to 128). The floor keeps a large group of copies, which lowers the
IDF of what it shares, from hiding its own members.

Document frequencies come from an exchange between blocks and shards (exchange.py). A text can reach the threshold with
another one only if shingles that other documents have too make up so much of its weight; the rest of the texts are
alone. The others get BANDS x ROWS consistent weighted samples; equal texts are merged; texts that share a band are
joined into candidate clusters; and in a cluster texts are compared by weighted Jaccard similarity, in tiles whose size
doesn't depend on the cluster's, until no two of different groups are left uncompared.

Defined cases: null and empty texts, and texts without words, are alone; equal texts are one class; of rows that repeat
an id and a text one is kept; a null id stands for no document, and such rows are kept; other columns are ignored, or
carried along by `kept`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .common import column, forget, stored
from .components import components
from .embedding_dedup import _forest
from .skew import heavy, skew_join

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 12, 4
IDF_FLOOR = 0.75
#: Texts of a candidate cluster that are compared with as many others at a time.
TILE = 48
SLACK = 1e-6

# Codes of document frequencies: 1 to 128 exactly, beyond in equal ratios up to 2 ** 40.
_CODES = np.r_[np.arange(0, 129), np.round(128 * 2 ** (np.arange(1, 127) * (33 / 126)))].astype(np.float64)


def _code(df: np.ndarray) -> np.ndarray:
    return np.minimum(np.searchsorted(_CODES, df), len(_CODES) - 1).astype(np.uint8)


def idf(codes: np.ndarray, n_docs: int) -> np.ndarray:
    share = np.log(np.maximum(n_docs / np.maximum(_CODES[codes], 1), 1)) / np.log(max(n_docs, 2))
    return IDF_FLOOR + (1 - IDF_FLOOR) * share


def _shingles(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle) with counts, ordered by shingle and text."""
    hashes, counts = X.word_hashes(texts)
    keys, owner = X.windows(hashes, counts, WORDS)
    short = np.flatnonzero((counts > 0) & (counts < WORDS))
    starts = np.cumsum(counts) - counts
    extra = [X.combine(*[hashes[s + j : s + j + 1] for j in range(c)])[0] for s, c in zip(starts[short], counts[short], strict=True)]
    keys = X.shorten(np.r_[keys, np.array(extra, dtype=np.uint64)], bits)
    owner = np.r_[owner, short]
    order = np.lexsort((owner, keys))
    keys, owner = keys[order], owner[order]
    if not len(keys):
        return keys, owner, np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])])
    return keys[first], owner[first], np.diff(np.r_[first, len(keys)])


def samples(shingles: np.ndarray, weights: np.ndarray, n: int = BANDS * ROWS) -> np.ndarray:
    """n consistent weighted samples of one weighted set, as hashes of (shingle, quantised weight)."""
    best, out = np.full(n, np.inf), np.zeros(n, np.uint64)
    seeds = X.mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for s in range(0, len(shingles), 2048):
        part, log_w = shingles[s : s + 2048], np.log(weights[s : s + 2048]).astype(np.float32)
        x = X.mix(part[None, :] ^ seeds[:, None])
        y = X.mix(x + np.uint64(1))
        unit = lambda z, shift, bits: ((z >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.float32) * np.float32(2.0**-bits) + np.float32(2.0 ** -(bits + 1))
        r = -np.log(unit(x, 43, 21) * unit(x, 22, 21))
        log_c = np.log(-np.log(unit(x, 0, 22) * unit(y, 42, 22)))
        beta = unit(y, 10, 22)
        t = np.floor(log_w[None, :] / r + beta)
        a = log_c - r * (t - beta + 1)
        at = a.argmin(axis=1)
        rows = np.arange(n)
        low = a[rows, at]
        better = low < best
        best = np.where(better, low, best)
        out = np.where(better, X.mix(part[at] + X.mix(t[rows, at].astype(np.int64).astype(np.uint64))), out)
    return out


def bands(sample: np.ndarray) -> np.ndarray:
    rows = sample.reshape(BANDS, ROWS)
    return X.combine(np.arange(BANDS, dtype=np.uint64), *rows.T).view(np.int64)


def _candidates(docs: DataFrame) -> DataFrame:
    """From (id, th, text): (id, th, bands, keys, weights) of the texts that can have a partner."""
    n_bytes = X.total_bytes(docs, "text")
    scale = X.task_scale(docs.sparkSession)
    n_docs, bits = docs.count(), X.shard_bits(n_bytes, scale)
    blocks = docs.withColumn("block", X.block_of(n_bytes, scale, F.col("id"), F.col("th")))

    def send(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["id", "th"], kind="stable")
        keys, _, _ = _shingles(frame["text"].tolist(), bits)
        keys, n = np.unique(keys, return_counts=True)
        block = int(frame["block"].iloc[0])
        rows = [(shard, block, X.pack(X.local_keys(keys[at])), X.small(n[at])) for shard, at in X.cut(keys, bits)]
        return pd.DataFrame(rows, columns=["shard", "block", "keys", "n"])

    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        keys = [X.unpack(k) for k in frame["keys"]]
        _, where = np.unique(np.concatenate(keys), return_inverse=True)
        df = np.bincount(where, np.concatenate([X.large(n) for n in frame["n"]]))
        codes = _code(df)[where]
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        return pd.DataFrame({"shard": frame["shard"], "block": frame["block"], "codes": [c.tobytes() for c in np.split(codes, cuts)]})

    def finish(frame: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        columns = ["id", "th", "bands", "keys", "weights"]
        if not len(frame) or not len(answers):
            return pd.DataFrame(columns=columns)
        frame = frame.sort_values(["id", "th"], kind="stable")
        keys, owner, tf = _shingles(frame["text"].tolist(), bits)
        distinct, where = np.unique(keys, return_inverse=True)
        got = {int(s): c for s, c in zip(answers["shard"], answers["codes"], strict=True)}
        codes = np.concatenate([np.frombuffer(got[s], np.uint8) for s, _ in X.cut(distinct, bits)])[where]
        weight = tf * idf(codes, n_docs)
        size = np.bincount(owner, weight, len(frame))
        shared = np.bincount(owner, weight * (codes > 1), len(frame))
        able = (size > 0) & (shared >= (THRESHOLD - SLACK) * size)
        inside = able[owner]
        order = np.argsort(owner[inside], kind="stable")
        keys, weight, owner = keys[inside][order], weight[inside][order].astype(np.float32), owner[inside][order]
        rows, cuts = [], np.r_[np.flatnonzero(np.r_[True, np.diff(owner) > 0]), len(owner)] if len(owner) else [0]
        ids, hashes = frame["id"].to_numpy(), frame["th"].to_numpy()
        done: dict = {}
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            th = hashes[owner[a]]
            if th not in done:
                done[th] = (bands(samples(keys[a:b], weight[a:b])), keys[a:b].tobytes(), weight[a:b].tobytes())
            rows.append((ids[owner[a]], th, *done[th]))
        return pd.DataFrame(rows, columns=columns)

    messages = blocks.groupBy("block").applyInPandas(send, "shard bigint, block bigint, keys binary, n binary")
    answers = stored(messages.groupBy("shard").applyInPandas(answer, "shard bigint, block bigint, codes binary"), "answers")
    out = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(finish, "id bigint, th string, bands array<bigint>, keys binary, weights binary")
    return stored(out, "candidates")


def similar(keys: list[np.ndarray], weights: list[np.ndarray]) -> np.ndarray:
    """Weighted Jaccard similarities of all pairs. min(a, b) is summed over the levels of weight that a shingle takes."""
    m = len(keys)
    row = np.repeat(np.arange(m), [len(k) for k in keys])
    key, w = np.concatenate(keys), np.concatenate(weights).astype(np.float64)
    size = np.bincount(row, w, m)
    _, col, n = np.unique(key, return_inverse=True, return_counts=True)
    often = n[col] > 1
    row, col, w = row[often], col[often], w[often]
    both = np.zeros((m, m))
    if len(row):
        # one layer for each column and level: the rows whose weight reaches it, worth the step from the level below
        pairs = np.unique(np.rec.fromarrays([col, w]), return_inverse=True)
        level_col, level_w = pairs[0].f0, pairs[0].f1
        below = np.r_[0.0, np.where(level_col[1:] == level_col[:-1], level_w[:-1], 0.0)]
        lowest = np.flatnonzero(np.r_[True, level_col[1:] != level_col[:-1]])
        own = pairs[1]
        reps = own - lowest[col_rank(level_col)[own]] + 1
        layer = np.repeat(own, reps) - (np.arange(int(reps.sum())) - np.repeat(np.cumsum(reps) - reps, reps))
        rows = np.repeat(row, reps)
        order = np.argsort(layer, kind="stable")
        layer, rows = layer[order], rows[order]
        step = np.sqrt(level_w - below)
        for s in range(0, len(level_w), 4096):
            a, b = np.searchsorted(layer, [s, s + 4096])
            held = np.zeros((m, min(4096, len(level_w) - s)))
            held[rows[a:b], layer[a:b] - s] = step[layer[a:b]]
            both += held @ held.T
    return both / np.maximum(size[:, None] + size[None, :] - both, 1e-300)


def col_rank(level_col: np.ndarray) -> np.ndarray:
    return np.cumsum(np.r_[False, level_col[1:] != level_col[:-1]])


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, class_id) of every document that may have a partner; others are classes of their own."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = _candidates(rows.withColumn("th", F.md5("text")))
    reps = found.groupBy("th").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    reps = stored(reps, "texts")
    texts = found.join(reps.select("th", F.col("rep").alias("id")), ["th", "id"]).dropDuplicates(["th"])
    texts = stored(texts.select(F.col("id").alias("rep"), "th", "bands", "keys", "weights"), "representatives")
    # a node is a text; its number is a hash of it
    spread = texts.select(F.xxhash64("th").alias("node"), F.explode("bands").alias("band"))
    shared = stored(spread.groupBy("band").agg(F.min("node").alias("low"), F.count("*").alias("n")).where("n > 1"), "bands")
    total = shared.agg(F.sum("n").alias("n")).first()["n"] or 0
    edges = skew_join(spread, shared.select("band", "low"), "band", heavy(shared, "band", "n", total))
    clusters = components(edges.select(F.col("node").alias("a"), F.col("low").alias("b")))
    clusters = stored(clusters.withColumnRenamed("id", "node").withColumnRenamed("component", "cluster"), "clusters")
    links = _links(texts.withColumn("node", F.xxhash64("th")).select("node", "keys", "weights"), clusters)
    groups = components(links).withColumnRenamed("id", "node")
    named = texts.select(F.xxhash64("th").alias("node"), "th", "rep").join(groups, "node", "left").withColumn("grp", F.coalesce("component", "node"))
    named = stored(named.select("th", "rep", "grp"), "named")
    lowest = stored(named.groupBy("grp").agg(F.min(F.struct("rep", "th")).alias("low"), F.count("*").alias("n")), "lowest")
    per_text = skew_join(named.select("th", "grp"), lowest.select("grp", "low"), "grp", heavy(lowest, "grp", "n", named.count()))
    per_text = stored(per_text.select("th", F.col("low.rep").alias("class_id"), F.col("low.th").alias("kept_th")), "classes")
    forget(shared, clusters, links, named, lowest, texts)
    first = (F.col("id") == F.col("class_id")) & (F.col("th") == F.col("kept_th"))
    each = found.groupBy("id", "th").agg(F.count("*").alias("n"))
    return skew_join(each, per_text, "th", heavy(reps, "th", "n", found.count())).select("id", "th", "n", "class_id", first.alias("kept"))


def _compared(rows: DataFrame) -> DataFrame:
    """Links (a, b) between the two sides of each group (cluster, a, b), or within a group of one side.

    rows is (cluster, a, b, side, node, keys, weights). A group gives back a forest of links, bounded by its rows.
    """

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in X.groups(frames, ["cluster", "a", "b"]):
            if len(g) < 2:
                continue
            s = similar([np.frombuffer(k, np.uint64) for k in g["keys"]], [np.frombuffer(w, np.float32) for w in g["weights"]])
            node, side = g["node"].to_numpy(), g["side"].to_numpy()
            if side.any():
                s = np.where((side[:, None] != side[None, :]) & (node[:, None] != node[None, :]), s, 0)
            i, j = np.nonzero(np.triu(s >= THRESHOLD - SLACK, 1))
            if len(i):
                member, root = _forest(i, j, len(g))
                yield pd.DataFrame({"a": node[member], "b": node[root]})

    dealt = rows.repartition("cluster", "a", "b").sortWithinPartitions("cluster", "a", "b")
    return stored(dealt.mapInPandas(compare, "a bigint, b bigint"), "links")


def _links(texts: DataFrame, clusters: DataFrame) -> DataFrame:
    """Links that connect the texts (node, keys, weights) of each cluster (node, cluster) as all links between them would.

    A cluster is cut into tiles. First its first tile is compared within itself and with every other one, which joins
    most of a group of near copies. Only members outside the largest component that results need more: they are
    compared with all members, tile by tile, so that every pair of different components is compared.
    """
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    sizes = stored(sizes.withColumn("tiles", F.ceil(F.col("n") / TILE).cast("int")), "sizes")
    total = sizes.agg(F.sum("n").alias("n"), F.max("tiles").alias("most")).first()
    hot = heavy(sizes, "cluster", "n", total["n"] or 0)
    placed = skew_join(clusters, sizes.select("cluster", "tiles"), "cluster", hot).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    members = stored(texts.join(placed, "node"), "clustered")
    columns = ("cluster", "a", "b", "side", "node", "keys", "weights")
    others = members.select("cluster", F.lit(0).alias("a"), F.col("tile").alias("b"), (F.col("tile") > 0).cast("int").alias("side"), "node", "keys", "weights")
    firsts = members.where("tile = 0 and tiles > 1").withColumn("b", F.explode(F.sequence(F.lit(1), F.col("tiles") - 1)))
    links = _compared(others.unionByName(firsts.select("cluster", F.lit(0).alias("a"), "b", F.lit(0).alias("side"), "node", "keys", "weights")))
    if (total["most"] or 0) > 1:
        wide = members.where("tiles > 1")
        now = wide.select("cluster", "node").join(components(links).withColumnRenamed("id", "node"), "node", "left")
        now = stored(now.select("cluster", "node", F.coalesce("component", "node").alias("component")), "now")
        parts = now.groupBy("cluster", "component").agg(F.count("*").alias("n"))
        tops = parts.groupBy("cluster").agg(F.max_by("component", F.struct("n", "component")).alias("top"), (F.sum("n") - F.max("n")).alias("waiting"))
        tops = stored(tops.where("waiting > 0").select("cluster", "top", F.ceil(F.col("waiting") / TILE).cast("int").alias("w_tiles")), "tops")
        if not tops.isEmpty():
            waiting = skew_join(now, tops, "cluster", hot).where("component <> top").select("node", F.pmod(F.xxhash64("node"), F.col("w_tiles")).cast("int").alias("a"))
            ahead = wide.join(waiting, "node").withColumn("b", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumn("side", F.lit(0))
            behind = skew_join(wide, tops.select("cluster", "w_tiles"), "cluster", hot).withColumn("a", F.explode(F.sequence(F.lit(0), F.col("w_tiles") - 1)))
            behind = behind.withColumn("b", F.col("tile")).withColumn("side", F.lit(1))
            links = links.unionByName(_compared(ahead.select(*columns).unionByName(behind.select(*columns))))
        forget(now, tops)
    forget(sizes, members)
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, class_id (the smallest id of its class), kept (one document of each class)."""
    found = stored(classes(docs, id_col, text_col), "members")
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("th"))
    out = rows.join(found, ["id", "th"], "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("kept", F.lit(True)).alias("kept"))


def kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class, with all its columns."""
    from pyspark.sql import Window

    found = stored(classes(docs, id_col, text_col), "members")
    rows = docs.select(F.struct(*map(column, docs.columns)).alias("doc"), F.col(id_col).cast("bigint").alias("id"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("th"))
    gone = found.where("not kept or n > 1").hint("shuffle_hash")
    out = rows.join(gone, ["id", "th"], "left").where("kept is null or kept")
    if not found.where("kept and n > 1").isEmpty():  # rows that repeat an id and a text
        nth = F.row_number().over(Window.partitionBy("id", "th").orderBy(F.lit(1)))
        out = out.withColumn("nth", nth).where("nth = 1 or kept is null")
    return out.select("doc.*")
