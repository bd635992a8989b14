"""Exact search in groups of any size: a group is divided into parts that lie apart, of which a query meets few.

A scan of whole groups costs queries times references. Where that is much, the references of each group are put into parts
of about PART_ROWS by a tree that a bounded sample shapes (all references are put into it), and lie in a part in leaves of
LEAF rows by medians. A query meets the part whose box is nearest, then all whose box is not farther than its k-th neighbour
so far; one that would meet more than WIDE of them meets the next few first. Within a part it goes by the boxes of the leaves
in the same way. A box at exactly the bound is met, so that ties by id come out right: the result is that of the scan.

Clusters are no boxes, and boxes around the parts of each overlap. So up to MOST_TOGETHER groups are divided together: a row
knows its group, and a query the set of groups that it asks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.topk import FOUND, FOUND_STEP, nearest_of
from tessera.plans.storage import kept

#: Pairs of a query and a reference from which groups are divided, and parts up to which they are.
MOST_PAIRS, MOST_PARTS = 1 << 30, 8192
#: References of a part (about, and at most), of a leaf, of a sample that shapes parts, and that a task holds while it deals them.
PART_ROWS, MOST_ROWS, LEAF, SAMPLE, HELD = 32_768, 65_536, 256, 131_072, 262_144
#: Pairs of a query and a part that a task holds at a time, queries that one group of a part takes, and that are met by leaves at a time.
ASKED, SALT_ROWS, STRIP = 1 << 20, 262_144, 4096
STRIP_BYTES, CACHED = 32 << 20, 128 << 10
#: Ranks of parts that a round meets, and of leaves.
ROUNDS, LEAVES = ((0, 1), (1, 8), (8, None)), (0, 1, 4, 16, 64)
#: Parts that a query meets at once, and ranks that it meets first if they are more; groups that are divided together.
WIDE, NEXT, MOST_TOGETHER = 24, 8, 62
#: More than what single precision errs by, as a share of the largest terms that are summed.
ERROR = 4e-6
#: Rows that wait for their exact distances at a time, and rows of a leaf that are near enough, in multiples of k for each query,
#: above which only those go on that the leaf's own k nearest leave.
HITS, MOST_HITS = 1 << 17, 2
#: Nearly the largest number of single precision: a limit that only infinity exceeds.
LARGEST = 3e38
PIECE = "node bigint, grp bigint, n int, ids binary, data binary, extra binary, own binary"
PART = "part bigint, grp bigint, n int, ids binary, data binary, extra binary, own binary, has bigint, low binary, high binary"
ASK = "part bigint, salt int, n int, q_ids binary, q_data binary, q_tau binary, q_step binary, q_asked binary"


def _tasks(df: DataFrame) -> int:
    return max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _batch(schema: str, columns: Sequence) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[f.split()[1]]) for f, c in zip(schema.split(", "), columns, strict=True)], names=[f.split()[0] for f in schema.split(", ")])


def ranges(n: int) -> np.ndarray:
    """Starts of the leaves of n rows: halves, again and again."""
    todo, out = [(0, n)], []
    while todo:
        a, b = todo.pop()
        if b - a <= LEAF:
            out.append(a)
        else:
            todo += [((a + b) // 2, b), (a, (a + b) // 2)]
    return np.array(out)


def by_leaves(x: np.ndarray) -> np.ndarray:
    """The order of rows in which those of a leaf lie together: by the median of the dimension that varies most."""
    order, todo = np.arange(len(x)), [(0, len(x))]
    while todo:
        a, b = todo.pop()
        if b - a > LEAF:
            own, middle = x[order[a:b]], (a + b) // 2
            wide = int(own.var(axis=0).argmax())
            order[a:b] = order[a:b][np.argpartition(own[:, wide], middle - a)]
            todo += [(a, middle), (middle, b)]
    return order


def shape(samples: dict[int, np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, dict[int, int]]:
    """(dimension, value, left, right of each node; the root of each group): nodes of more than `least` sampled rows are cut
    at the median of the dimension that varies most, unless all their rows are equal."""
    nodes: list[list] = []
    roots = {}
    for grp, x in samples.items():
        roots[grp] = len(nodes)
        nodes.append([0, 0.0, -1, -1])
        todo = [(x, roots[grp])]
        while todo:
            part, node = todo.pop()
            if len(part) <= least:
                continue
            spread = part.var(axis=0)
            for wide in np.argsort(-spread, kind="stable").tolist():
                if not spread[wide] > 0:
                    break
                value = float(np.median(part[:, wide]))
                low = part[:, wide] < value
                if not low.any():  # more than half have the least value
                    value += 0.5
                    low = part[:, wide] < value
                if low.any() and not low.all():
                    nodes[node] = [wide, value, len(nodes), len(nodes) + 1]
                    nodes += [[0, 0.0, -1, -1], [0, 0.0, -1, -1]]
                    todo += [(part[low], len(nodes) - 2), (part[~low], len(nodes) - 1)]
                    break
    dim, value, left, right = (np.array(c) for c in zip(*nodes, strict=True))
    return dim, value, left, right, roots


class Parts:
    """The parts of all groups: their frame, and for each its number, group, rows and box. Where groups are divided together,
    `together` numbers them, and `has` is the set of those that a part holds."""

    def __init__(self, frame: DataFrame, dims: int, together: dict[int, int] | None = None):
        self.frame, self.dims, self.together = frame, dims, together
        rows = frame.select("part", "grp", "n", "has", "low", "high").collect()  # bounded: a row for tens of thousands of references
        self.part, self.grp, self.n, self.has = (np.array([r[c] for r in rows], np.int64) for c in ("part", "grp", "n", "has"))
        self.low, self.high = (np.frombuffer(b"".join(bytes(r[c]) for r in rows), np.int32).reshape(-1, dims).astype(np.float64) for c in ("low", "high"))


def divide(tiles: DataFrame, dims: int, sizes: dict[int, int], together: bool = False) -> Parts:
    """Parts of tiles (grp, n, ids, data, extra), in whatever order those hold the references of groups of these sizes."""
    total = sum(sizes.values())
    numbers = {g: i for i, g in enumerate(sorted(sizes))} if together else None
    if together and len(sizes) > MOST_TOGETHER:
        raise ValueError(f"more than {MOST_TOGETHER} groups can't be divided together")
    every = max(1, total // SAMPLE)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.uint64)
                some = ((ids * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)) % np.uint64(every) == 0
                yield _batch("grp bigint, data binary", ([row["grp"]], [np.frombuffer(row["data"], np.int32).reshape(-1, dims)[some].tobytes()]))

    drawn: dict[int, list] = {g: [] for g in sizes}
    for r in tiles.select("grp", "ids", "data").mapInArrow(sampled, "grp bigint, data binary").where(F.octet_length("data") > 0).collect():
        drawn[r["grp"]].append(np.frombuffer(bytes(r["data"]), np.int32).reshape(-1, dims))
    if together:
        drawn = {0: [x for d in drawn.values() for x in d]}
    samples = {g: np.concatenate(d).astype(np.float64) if d else np.zeros((0, dims)) for g, d in drawn.items()}
    dim, value, left, right, roots = shape(samples or {0: np.zeros((0, dims))}, max(1, PART_ROWS // every))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                node, grp, ids, data, extra, own = (np.concatenate(c) for c in zip(*held, strict=True))
                sort = np.argsort(node, kind="stable")
                node, grp, ids, data, extra, own = node[sort], grp[sort], ids[sort], data[sort], extra[sort], own[sort]
                cuts = [0, *(np.flatnonzero(np.diff(node)) + 1).tolist(), len(node)]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    yield _batch(PIECE, ([node[a]], [grp[a]], [b - a], [ids[a:b].tobytes()], [data[a:b].tobytes()], [extra[a:b].tobytes()], [own[a:b].tobytes()]))
                held.clear()

        for batch in batches:
            for s in range(batch.num_rows):
                row = batch.slice(s, 1).to_pylist()[0]
                ids, extra = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["extra"], np.int32)
                data = np.frombuffer(row["data"], np.int32).reshape(-1, dims)
                grp = 0 if together else row["grp"]
                node = np.full(len(ids), roots[grp])
                while (inner := np.flatnonzero(left[node] >= 0)).size:
                    at = node[inner]
                    node[inner] = np.where(data[inner, dim[at]] < value[at], left[at], right[at])
                held.append((node, np.full(len(ids), grp), ids, data, extra, np.full(len(ids), numbers[row["grp"]] if together else 0, np.uint8)))
                if sum(len(h[0]) for h in held) >= HELD:
                    yield from flush()
        yield from flush()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, of, seq = 0, None, TaskContext.get().partitionId() << 32

        def flush(whole: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size, seq
            while size >= MOST_ROWS or (whole and size):
                ids, data, extra, own = (np.concatenate(c) for c in zip(*held, strict=True))
                rest = [tuple(c[MOST_ROWS:] for c in (ids, data, extra, own))] if size > MOST_ROWS else []
                ids, data, extra, own = ids[:MOST_ROWS], data[:MOST_ROWS], extra[:MOST_ROWS], own[:MOST_ROWS]
                order = by_leaves(data)
                ends = data.min(axis=0).tobytes(), data.max(axis=0).tobytes()
                has = int(np.bitwise_or.reduce(np.int64(1) << own.astype(np.int64)))
                yield _batch(PART, ([seq], [of[1]], [len(ids)], [ids[order].tobytes()], [data[order].tobytes()], [extra[order].tobytes()], [own[order].tobytes()], [has], [ends[0]], [ends[1]]))
                held, size, seq = rest, size - len(ids), seq + 1

        for batch in batches:
            for s in range(batch.num_rows):
                row = batch.slice(s, 1).to_pylist()[0]
                if of is not None and row["node"] != of[0]:
                    yield from flush(True)
                of = row["node"], row["grp"]
                held.append((np.frombuffer(row["ids"], np.int64), np.frombuffer(row["data"], np.int32).reshape(-1, dims), np.frombuffer(row["extra"], np.int32), np.frombuffer(row["own"], np.uint8)))
                size += row["n"]
                yield from flush(False)
        yield from flush(True)

    pieces = tiles.select("grp", "ids", "data", "extra").mapInArrow(dealt, PIECE)
    made = pieces.repartition(_tasks(tiles), "node").sortWithinPartitions("node").mapInArrow(packed, PART)
    return Parts(kept(made, lasting=True), dims, numbers)


def fits(sizes: dict[int, int], asked: dict[int, int]) -> bool:
    """Whether groups of these sizes, asked by so many queries, are worth to be divided."""
    pairs = sum(n * sizes.get(g, 0) for g, n in asked.items())
    return pairs >= MOST_PAIRS and sum(-(-n // PART_ROWS) for n in sizes.values()) <= MOST_PARTS


def rows_of(asked: DataFrame, dims: int, together: dict[int, int] | None = None) -> DataFrame:
    """(qid, data, groups, steps) of blocks of queries: one row a query; (qid, data, asked), with the set of groups, where they
    are divided together."""
    if together is not None:

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    # a group without references has no number
                    if row["n"]:
                        one = 1 << together[row["grp"]] if row["grp"] in together else 0
                        wide = 4 * dims
                        yield _batch("qid bigint, asked bigint, data binary", (np.frombuffer(row["q_ids"], np.int64), np.full(row["n"], one), [row["q_data"][s : s + wide] for s in range(0, row["n"] * wide, wide)]))

        each = asked.select("grp", "n", "q_ids", "q_data").mapInArrow(sets, "qid bigint, asked bigint, data binary")
        return each.groupBy("qid").agg(F.first("data").alias("data"), F.bit_or("asked").alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = row["n"]
                if n:
                    ids, step = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["q_step"], np.int32)
                    wide = 4 * dims
                    yield _batch("qid bigint, grp bigint, step int, data binary", (ids, np.full(n, row["grp"]), step, [row["q_data"][s : s + wide] for s in range(0, n * wide, wide)]))

    each = asked.select("grp", "n", "q_ids", "q_data", "q_step").mapInArrow(run, "qid bigint, grp bigint, step int, data binary")
    return each.groupBy("qid").agg(F.first("data").alias("data"), F.collect_list(F.struct("grp", "step")).alias("g")).select("qid", "data", F.col("g.grp").alias("groups"), F.col("g.step").alias("steps"))


def rows_of_all(queries: DataFrame, vector: Sequence[str], query_id: str) -> DataFrame:
    """(qid, data) of queries that ask all groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, wide = np.stack([batch[v].to_numpy() for v in vector], axis=1).astype(np.int32).tobytes(), 4 * len(vector)
            yield _batch("qid bigint, data binary", (batch["qid"], [data[s : s + wide] for s in range(0, len(data), wide)]))

    return queries.select(F.col(query_id).cast("bigint").alias("qid"), *[F.col(v).cast("int").alias(v) for v in vector]).mapInArrow(run, "qid bigint, data binary")


def bounds(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least squared distance of each row of x from each box, in single precision: less by up to one in 50,000, never more."""
    total = np.zeros((len(x), len(low)), np.float32)
    middle, half = ((low + high) / 2).astype(np.float32), ((high - low) / 2).astype(np.float32)
    x = x.astype(np.float32)
    rows = max(1, CACHED // (4 * max(1, len(low))))
    for s in range(0, len(x), rows):
        part, sum_ = x[s : s + rows], total[s : s + rows]
        for d in range(x.shape[1]):
            out = part[:, d, None] - middle[:, d]
            np.abs(out, out=out)
            out -= half[:, d]
            np.maximum(out, 0, out=out)
            out *= out
            sum_ += out
    total *= np.float32(1 - 1e-5)
    return total


def asks(asking: DataFrame, parts: Parts, first: int, upto: int | None, later: bool, wide: int | None = None) -> DataFrame:
    """ASK: the parts that queries (qid, data, tau; maybe groups, steps, or asked) meet, by rank of (bound, part) from first on,
    as far as they are not beyond tau. Only groups of a query's least step count, or with `later` only the others. Queries
    with more than `wide` parts meet those of ranks below NEXT, and are listed as part -1."""
    dims, number, low, high, has = parts.dims, parts.part, parts.low, parts.high, parts.has
    groups, of = np.unique(parts.grp, return_inverse=True)
    size = max(1, len(number))
    strip = max(1, STRIP_BYTES // (8 * size))
    by_group, by_set = "groups" in asking.columns, "asked" in asking.columns
    whole = int(np.bitwise_or.reduce(has)) if len(has) else 0

    def ranked(near: np.ndarray, home: np.ndarray, first: int, upto: int | None) -> np.ndarray:
        """Whether parts are of rank first to upto; the nearest one is of rank 0."""
        out = np.ones(near.shape, bool)
        # whole numbers that no two parts share
        key = np.where(np.isfinite(near), near, 1 << 40).astype(np.int64) * (1 << 17) + np.arange(near.shape[1])
        key[np.arange(len(key)), home] = -1
        for bound, side in ((first, True), (upto, False)):
            if bound and bound < key.shape[1]:
                edge = np.partition(key, bound, axis=1)[:, bound, None]
                out &= (key >= edge) if side else (key < edge)
            elif bound and side:
                out[:] = False
        return out

    def chosen(x: np.ndarray, tau: np.ndarray, lists: tuple | None, sets: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        near = bounds(x, low, high)
        step = None
        if lists is not None:
            row, grp, own = lists
            at = np.minimum(np.searchsorted(groups, grp), len(groups) - 1)
            row, at, own = row[groups[at] == grp], at[groups[at] == grp], own[groups[at] == grp]  # a group without references has no part
            told = np.full((len(x), len(groups)), 1 << 30, np.int32)
            told[row, at] = own
            least = told.min(axis=1)
            step = told[:, of]
            near[(step == 1 << 30) | ((step > least[:, None]) != later)] = np.inf
        if sets is not None and (sets & whole != whole).any():
            near[(sets[:, None] & has[None, :]) == 0] = np.inf
        rows, many = np.arange(len(x)), np.zeros(0, np.int64)
        home = near.argmin(axis=1)
        if (first, upto) == (0, 1):
            i = np.flatnonzero(np.isfinite(near[rows, home]) & (near[rows, home] <= tau))
            j = home[i]
        else:
            inside = np.isfinite(near) & (near <= tau[:, None])
            if first == 1:
                inside[rows, home] = False
            if first > 1 or upto is not None:
                inside &= ranked(near, home, first, upto)
            if wide is not None:
                many = np.flatnonzero(inside.sum(axis=1) > wide)
                if len(many):
                    inside[many] &= ranked(near[many], home[many], 0, NEXT)
            i, j = np.nonzero(inside)
        return i, j, np.zeros(len(i), np.int32) if step is None else step[i, j], many

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                j, *columns = (np.concatenate(c) for c in zip(*held, strict=True))
                sort = np.argsort(j, kind="stable")
                j, columns = j[sort], [c[sort] for c in columns]
                cuts = [0, *(np.flatnonzero(np.diff(j)) + 1).tolist(), len(j)]
                out = [(number[j[a]], 0, b - a, *(c[a:b].tobytes() for c in columns)) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]
                if out:
                    yield _batch(ASK, list(zip(*out, strict=True)))
                held.clear()

        seen = 0
        for batch in batches:
            ids, tau = batch["qid"].to_numpy(), batch["tau"].to_numpy()
            data = np.frombuffer(b"".join(batch["data"].to_pylist()), np.int32).reshape(-1, dims)
            asked = batch["asked"].to_numpy() if by_set else np.zeros(len(ids), np.int64)
            if by_group:
                lists = batch["groups"]
                offsets, grp, own = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten().to_numpy(), batch["steps"].flatten().to_numpy()
            for s in range(0, len(ids), strip):
                e, some = min(len(ids), s + strip), None
                if by_group:
                    a, b = offsets[s], offsets[e]
                    some = np.repeat(np.arange(e - s), np.diff(offsets[s : e + 1])), grp[a:b], own[a:b]
                if not len(number):
                    continue
                i, j, step, many = chosen(data[s:e].astype(np.float64), tau[s:e], some, asked[s:e] if by_set else None)
                if len(many):
                    yield _batch(ASK, ([-1], [0], [len(many)], [ids[s:e][many].tobytes()], [b""], [b""], [b""], [b""]))
                held.append((j, ids[s:e][i], data[s:e][i], tau[s:e][i], step, asked[s:e][i]))
                seen += len(i)
                if seen >= ASKED:
                    yield from flush()
                    seen = 0
        yield from flush()

    return asking.mapInArrow(run, ASK)


def nearest(q: np.ndarray, tau: np.ndarray, r: np.ndarray, ids: np.ndarray, k: int, asked: np.ndarray | None = None, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of q, rows of r, squared distances) of the k nearest not beyond tau, by (distance, id); r lies in its leaves. With
    asked, only rows whose group `own` is in a query's set count.

    Distances are computed in single precision first, and exactly for rows that may be near enough after what it errs by. Where
    tau is loose these are many: they are settled HITS at a time, which tightens the bound, so that memory doesn't grow with them.
    """
    starts = ranges(len(r))
    ends = np.r_[starts[1:], len(r)]
    low, high = (f.reduceat(r, starts, axis=0).astype(np.float64) for f in (np.minimum, np.maximum))
    middle = np.floor((low.min(axis=0) + high.max(axis=0)) / 2)
    ref = r - middle
    norm = (ref * ref).sum(axis=1)
    reach = np.sqrt(norm.max())
    # a row times a column is the whole distance
    turned = np.concatenate([ref.T * -2, np.ones((1, len(r))), norm[None]]).astype(np.float32)
    if asked is not None:
        has = np.bitwise_or.reduceat(np.int64(1) << own.astype(np.int64), starts)
        whole = np.bitwise_or.reduce(has)
        if (asked & whole == whole).all():
            asked = None
    out = []
    for s in range(0, len(q), STRIP):
        x, most = q[s : s + STRIP] - middle, tau[s : s + STRIP].copy()
        square = (x * x).sum(axis=1)
        errs = ERROR * (np.sqrt(square) + reach) ** 2 + 1
        row32 = np.concatenate([x, square[:, None], np.ones((len(x), 1))], axis=1).astype(np.float32)
        sets = None if asked is None else asked[s : s + STRIP]
        near = bounds(q[s : s + STRIP], low, high)
        if sets is not None:
            near[(sets[:, None] & has[None, :]) == 0] = np.inf
        near[~np.isfinite(near)] = np.nan  # never met
        open_ = not np.isfinite(most).all()
        if open_:
            order = np.argsort(near, axis=1, kind="stable")
            near = np.take_along_axis(near, order, axis=1)
        stages = list(zip(LEAVES, (*LEAVES[1:], len(starts)), strict=True)) if open_ else [(0, len(starts))]
        top = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.float64))
        hits: list[tuple] = []
        waiting = 0

        def limits(rows: np.ndarray, limit: np.ndarray) -> np.ndarray:
            return np.minimum(limit + errs[rows], LARGEST).astype(np.float32)[:, None]

        def settle() -> None:
            """Takes what waits into the k nearest so far, by exact distances."""
            nonlocal top, most, waiting
            row, col = (np.concatenate(c) for c in zip(*hits, strict=True))
            hits.clear()
            waiting = 0
            for h in range(0, len(row), HITS):
                r_, c_ = row[h : h + HITS], col[h : h + HITS]
                d = x[r_] - ref[c_]
                d = np.einsum("ij,ij->i", d, d)
                good = d <= most[r_]
                r_, c_, d = (np.concatenate(c) for c in zip(top, (r_[good], c_[good], d[good]), strict=True))
                keep = nearest_of((ids[c_], d), (r_,), k)
                top = r_[keep], c_[keep], d[keep]
                count = np.bincount(top[0], minlength=len(x))
                last = np.full(len(x), -1.0)
                np.maximum.at(last, top[0], top[2])
                most = np.where(count >= k, np.minimum(most, last), most)

        for a, b in stages:
            i, at = np.nonzero(near[:, a:b] <= most[:, None])
            if not len(i):
                break  # boxes only get farther
            bound, leaf = near[i, a + at], order[i, a + at] if open_ else at
            sort = np.argsort(leaf, kind="stable")
            i, leaf, bound = i[sort], leaf[sort], bound[sort]
            part = None if sets is None else (sets[i] & has[leaf]) != has[leaf]
            cuts = [0, *(np.flatnonzero(np.diff(leaf)) + 1).tolist(), len(leaf)]
            for c, e in zip(cuts[:-1], cuts[1:], strict=True):
                rows, f, t = i[c:e], starts[leaf[c]], ends[leaf[c]]
                some = None if part is None else part[c:e]
                inside = bound[c:e] <= most[rows]  # what was settled meanwhile may rule the leaf out
                if not inside.all():
                    rows, some = rows[inside], None if some is None else some[inside]
                if not len(rows):
                    continue
                d = row32[rows] @ turned[:, f:t]
                near_enough = np.flatnonzero(d <= limits(rows, most[rows]))
                mixed = np.flatnonzero(some) if some is not None else ()
                if t - f > k and len(near_enough) > MOST_HITS * k * len(rows):
                    # the k nearest of a leaf, of the groups that a query asks, bound what else it needs of it
                    if len(mixed):
                        d[mixed] = np.where((sets[rows[mixed], None] >> own[None, f:t].astype(np.int64)) & 1, d[mixed], np.inf)
                    least = np.partition(d, k - 1, axis=1)[:, k - 1] + errs[rows]
                    near_enough = np.flatnonzero(d <= limits(rows, np.minimum(most[rows], least)))
                hit, col = np.divmod(near_enough, t - f)
                if len(mixed):
                    # rows of groups that a query doesn't ask are no candidates, however near
                    asks_it = (sets[rows[hit]] >> own[f + col].astype(np.int64)) & 1 == 1
                    hit, col = hit[asks_it], col[asks_it]
                hits.append((rows[hit], col + f))
                waiting += len(hit)
                if waiting >= HITS:
                    settle()
            if hits:
                settle()
        out.append((top[0] + s, top[1], top[2].astype(np.int64)))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _meet(asked: DataFrame, parts: Parts, k: int, with_step: bool) -> DataFrame:
    """FOUND of what is asked; parts that very many queries ask are given to several groups."""
    spark, dims, schema, by_set = asked.sparkSession, parts.dims, FOUND_STEP if with_step else FOUND, parts.together is not None
    asked = asked.where("part >= 0")
    hot = {r["part"]: -(-r["n"] // SALT_ROWS) for r in asked.groupBy("part").agg(F.sum("n").alias("n")).where(F.col("n") > SALT_ROWS).collect()}  # at most all parts
    frame = parts.frame.select("part", "ids", "data", "extra", "own").withColumn("salt", F.lit(0))
    if hot:
        told = F.broadcast(spark.createDataFrame(sorted(hot.items()), "part bigint, salts int"))
        salts = F.coalesce(F.col("salts"), F.lit(1))
        frame = frame.join(told, "part", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
        asked = asked.join(told, "part", "left").withColumn("salt", F.pmod(F.xxhash64("q_ids"), salts).cast("int")).drop("salts")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        for part in right.to_pylist():  # one, or none
            q_ids, q_tau, q_step = (np.frombuffer(b"".join(left[c].to_pylist()), t) for c, t in (("q_ids", np.int64), ("q_tau", np.float64), ("q_step", np.int32)))
            q = np.frombuffer(b"".join(left["q_data"].to_pylist()), np.int32).reshape(-1, dims)
            if len(q):
                ids = np.frombuffer(part["ids"], np.int64)
                sets = (np.frombuffer(b"".join(left["q_asked"].to_pylist()), np.int64), np.frombuffer(part["own"], np.uint8)) if by_set else ()
                i, j, d = nearest(q, q_tau, np.frombuffer(part["data"], np.int32).reshape(-1, dims), ids, k, *sets)
                found.append(_batch(schema, (q_ids[i], ids[j], d, np.frombuffer(part["extra"], np.int32)[j], *([q_step[i]] if with_step else []))))
        return pa.Table.from_batches(found) if found else pa.Table.from_batches([_batch(schema, [[]] * len(schema.split(", ")))])

    asked = asked.select("part", "salt", "q_ids", "q_data", "q_tau", "q_step", "q_asked")
    tasks = 4 * _tasks(asked)  # parts are asked by more or fewer queries
    return asked.repartition(tasks, "part", "salt").groupBy("part", "salt").cogroup(frame.repartition(tasks, "part", "salt").groupBy("part", "salt")).applyInArrow(run, schema)


def search(asking: DataFrame, parts: Parts, k: int, known: DataFrame | None = None, with_step: bool = False) -> DataFrame:
    """FOUND (FOUND_STEP) among the parts of the groups that (qid, data; maybe groups, steps, or asked) ask: for each query the k
    nearest are there, and with steps those of every step and the ones before it. known is what was found elsewhere."""
    columns = ["qid", "d2"]
    asking = kept(asking)
    # what lies beyond the k-th of an earlier step is beyond it for all later ones
    near = None if known is None or with_step else known.select(*columns)
    out: DataFrame | None = None
    if with_step:
        rounds = [(a, b, False, None) for a, b in ROUNDS] + [(0, None, True, None)]
    else:
        rounds = [*([(0, 1, False, None)] if near is None else []), (1 if near is None else 0, None, False, WIDE), (NEXT, None, False, None)]
    for first, upto, later, wide in rounds:
        if near is None:
            told = asking.withColumn("tau", F.lit(float("inf")))
        else:
            kth = F.get(F.array_sort(F.collect_list("d2")), F.lit(k - 1))
            tau = near.groupBy("qid").agg(F.coalesce(kth.cast("double"), F.lit(float("inf"))).alias("tau"))
            told = asking.join(tau, "qid", "left").withColumn("tau", F.coalesce("tau", F.lit(float("inf"))))
        asked = kept(asks(told, parts, first, upto, later, wide))
        got = kept(_meet(asked, parts, k, with_step))
        near = got.select(*columns) if near is None else near.unionByName(got.select(*columns))
        out = got if out is None else out.unionByName(got)
        if wide is not None:
            listed = asked.where("part < 0")
            if listed.isEmpty():
                break
            # those that go on are written once
            asking = kept(asking.join(_ids(listed), "qid", "left_semi"))
    return out


def _ids(listed: DataFrame) -> DataFrame:
    """(qid) of what asks() lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch("qid bigint", (np.frombuffer(b"".join(batch["q_ids"].to_pylist()), np.int64),))

    return listed.select("q_ids").mapInArrow(run, "qid bigint")
