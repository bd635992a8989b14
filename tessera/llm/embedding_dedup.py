"""Near-duplicate vectors by PCA-ordered tiled comparison.

Equal vectors of a label are first merged into one with a multiplicity. Unit vectors are rotated to their principal
axes (fitted on all of them: one d x d matrix of sums) and range-partitioned by label and leading coordinate into
tiles of at most `tile` rows. A pair of tiles of one label is compared only if the intervals of their leading
coordinate are near enough. Inside a pair, products are accumulated over blocks of leading dimensions; what the rest
can add is bounded by the product of the suffix norms, and the work stops once no pair of rows can reach the threshold.
Survivors are verified by the cosine of the original vectors in double precision.

A pair of tiles gives back counts of links and a spanning forest, never the links themselves, so that its output is
bounded by its rows. Components are found from the forests.

Defined cases: null labels, null, empty, zero and non-finite vectors, and vectors with null components link with
nothing; vectors of different lengths don't link; a null id has no links and no component; each row of a repeated id is
a vector of its own for n_links, and they share a component; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import column, stored
from .components import components

TILE = 2048
#: Rows of one side of a product that is held at a time, and dimensions that are added before the bound is tested.
STRIP, BLOCK = 512, 16
SLACK = 1e-9


def _unit(vectors: np.ndarray) -> np.ndarray:
    # scaling by the largest component first keeps very large and very small vectors finite
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _axes(reps: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vectors, the principal axes as columns, leading ones first."""

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for f in frames:
            for d, part in f.groupby("d"):
                x = _unit(np.stack(part["v"].to_numpy()).astype(np.float64))
                sums[d] = sums.get(d, 0) + x.T @ x
        yield pd.DataFrame({"d": list(sums), "m": [m.tobytes() for m in sums.values()]}).astype({"d": "int32"})

    def add(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"d": f["d"].iloc[:1].astype("int32"), "m": [np.sum([np.frombuffer(m) for m in f["m"]], axis=0).tobytes()]})

    out = {}
    for row in reps.select("d", "v").mapInPandas(partial, "d int, m binary").groupBy("d").applyInPandas(add, "d int, m binary").toLocalIterator():
        m = np.frombuffer(row["m"]).reshape(row["d"], row["d"])
        out[row["d"]] = np.linalg.eigh(m)[1][:, ::-1].copy()
    return out


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, smallest member) that connect what the links i-j connect."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    member = np.flatnonzero(root != np.arange(n))
    return member, root[member]


def _links(a: np.ndarray, b: np.ndarray, raw_a: np.ndarray, raw_b: np.ndarray, least: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i, j) of two tiles whose cosine is at least `least`; of a tile with itself only i < j."""
    d = a.shape[1]
    cuts = list(range(0, d, BLOCK)) + [d]
    rest = lambda x: [np.sqrt(np.maximum((x[:, c:] ** 2).sum(axis=1), 0)) for c in cuts[1:]]
    rest_b = rest(b)
    for s in range(0, len(a), STRIP):
        strip = a[s : s + STRIP]
        rest_s, total, live = rest(strip), np.zeros((len(strip), len(b))), True
        for k in range(len(cuts) - 1):
            total += strip[:, cuts[k] : cuts[k + 1]] @ b[:, cuts[k] : cuts[k + 1]].T
            if k + 2 < len(cuts) and float((total + np.outer(rest_s[k], rest_b[k])).max()) < least - SLACK:
                live = False
                break
        if not live:
            continue
        i, j = np.nonzero(total >= least - SLACK)
        i += s
        if same:
            i, j = i[i < j], j[i < j]
        for t in range(0, len(i), 1 << 16):
            p, q = i[t : t + (1 << 16)], j[t : t + (1 << 16)]
            ok = np.einsum("ij,ij->i", raw_a[p], raw_b[q]) >= least
            if ok.any():
                yield p[ok], q[ok]


def link(vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", tile: int = TILE) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept (id = component_id)."""
    spark = vectors.sparkSession
    finite = F.forall(F.col("__v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    # vectors travel in the precision that they have
    single = isinstance(getattr(vectors.schema[vec_col].dataType, "elementType", None), FloatType)
    kind = np.float32 if single else np.float64
    rows = vectors.select(column(id_col).cast("bigint").alias("__id"), column(vec_col).cast(f"array<{'float' if single else 'double'}>").alias("__v"), column(label_col).alias("label"))
    good = F.coalesce(F.col("__id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("__v", lambda x: x != 0), F.lit(False))
    rows = rows.select("__id", "label", F.when(good, F.col("__v")).alias("v"))
    rows = rows.withColumns({"h1": F.when(F.col("v").isNotNull(), F.xxhash64("label", "v")), "h2": F.when(F.col("v").isNotNull(), F.xxhash64(F.lit("second"), "v", "label"))})
    reps = rows.where("v is not null").groupBy("label", "h1", "h2").agg(F.min("__id").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v"))
    reps = stored(reps.withColumn("d", F.size("v")), "vectors")
    axes = _axes(reps)
    far = float(np.sqrt(max(0.0, 2 - 2 * least))) + SLACK

    def lead(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = np.empty(len(f))
            d = f["d"].to_numpy()
            for size in np.unique(d):
                at = np.flatnonzero(d == size)
                x[at] = _unit(np.stack(f["v"].iloc[at].to_numpy()).astype(np.float64)) @ axes[size][:, 0]
            yield f.assign(x=x)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in reps.schema)
    ordered = reps.mapInPandas(lead, f"{kinds}, x double")
    parts = max(1, -(-reps.count() // tile))
    ordered = ordered.repartitionByRange(parts, "label", "d", "x").sortWithinPartitions("label", "d", "x")
    blob = "label string, d int, n int, lo double, hi double, rep binary, h1 binary, many binary, raw binary"

    def tiles(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def cut(f: pd.DataFrame) -> pd.DataFrame:
            raw = np.stack(f["v"].to_numpy()).astype(kind)
            return pd.DataFrame({"label": [str(f["label"].iloc[0])], "d": [int(f["d"].iloc[0])], "n": [len(f)], "lo": [f["x"].iloc[0]], "hi": [f["x"].iloc[-1]], "rep": [f["rep"].to_numpy(np.int64).tobytes()], "h1": [f["h1"].to_numpy(np.int64).tobytes()], "many": [f["n"].to_numpy(np.int64).tobytes()], "raw": [raw.tobytes()]})

        def ready(last: bool) -> Iterator[pd.DataFrame]:
            nonlocal held
            if not held:
                return
            f = pd.concat(held, ignore_index=True)
            groups = [g for _, g in f.groupby(["label", "d"], sort=False)]
            held = []
            for k, g in enumerate(groups):
                whole = last or k < len(groups) - 1
                for s in range(0, len(g), tile):
                    piece = g.iloc[s : s + tile]
                    if whole or len(piece) == tile:
                        yield cut(piece)
                    else:
                        held = [piece]

        for f in frames:
            held.append(f)
            if sum(map(len, held)) >= tile:
                yield from ready(False)
        yield from ready(True)

    made = stored(ordered.mapInPandas(tiles, blob).withColumn("tile", F.monotonically_increasing_id()), "tiles")
    meta = made.select("tile", "label", "d", "lo", "hi")
    other = meta.select(F.col("tile").alias("tile_b"), "label", "d", F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"))
    pairs = meta.join(other, ["label", "d"]).where((F.col("tile") <= F.col("tile_b")) & (F.col("lo") <= F.col("hi_b") + far) & (F.col("lo_b") <= F.col("hi") + far)).select("tile", "tile_b")
    second = made.select(F.col("tile").alias("tile_b"), F.col("rep").alias("rep_b"), F.col("h1").alias("h1_b"), F.col("many").alias("many_b"), F.col("raw").alias("raw_b"))
    work = pairs.join(second, "tile_b").join(made.select("tile", "d", "rep", "h1", "many", "raw"), "tile")

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                unpack = lambda x, to=np.int64: np.frombuffer(x, dtype=to)
                same = r.tile == r.tile_b
                raw_a, raw_b = (_unit(unpack(x, kind).reshape(-1, r.d).astype(np.float64)) for x in (r.raw, r.raw_b))
                n_a, n_b = len(raw_a), len(raw_b)
                links, edges_i, edges_j = np.zeros(n_a + n_b, np.int64), [], []
                shift = 0 if same else n_a
                many = np.r_[unpack(r.many), unpack(r.many_b)]
                for i, j in _links(raw_a @ axes[r.d], raw_b @ axes[r.d], raw_a, raw_b, least, same):
                    j = j + shift
                    links += np.bincount(i, many[j], n_a + n_b).astype(np.int64) + np.bincount(j, many[i], n_a + n_b).astype(np.int64)
                    member, root = _forest(i, j, n_a + n_b)
                    edges_i.append(member)
                    edges_j.append(root)
                if not edges_i:
                    continue
                member, root = _forest(np.concatenate(edges_i), np.concatenate(edges_j), n_a + n_b)
                rep, h1 = np.r_[unpack(r.rep), unpack(r.rep_b)], np.r_[unpack(r.h1), unpack(r.h1_b)]
                at = np.flatnonzero(links)
                head = np.full(n_a + n_b, -1, np.int64)
                head[member] = root
                yield pd.DataFrame({"rep": rep[at], "h1": h1[at], "links": links[at], "root": pd.array(np.where(head[at] >= 0, rep[head[at]], rep[at]), dtype="int64")})

    found = stored(work.repartition(max(1, parts), "tile", "tile_b").mapInPandas(compare, "rep bigint, h1 bigint, links bigint, root bigint"), "links")
    groups = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    sums = found.groupBy("h1", "rep").agg(F.sum("links").alias("links"))
    each = reps.select("label", "h1", "h2", "rep", "n").join(sums, ["h1", "rep"], "left").join(groups.withColumnRenamed("id", "rep"), "rep", "left")
    each = stored(each.select("h1", "h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "classes")
    out = rows.select("__id", "h1", "h2").join(each, ["h1", "h2"], "left")
    component = F.coalesce("component_id", "__id")
    return out.select(F.col("__id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("__id") == component, F.lit(False)).alias("kept"))
