"""An index of references as tiles of their groups (clusters or cells), and its scan by blocks of queries.

References are range-partitioned by group and id and cut into tiles, so that a group of any size is dealt over tasks. What
asks a group is a block of queries. Blocks are broadcast up to a counted size: then each task streams its tiles past them,
and the index side is read where it lies, without an exchange, and only from the folders of the shards that are asked.
Larger sets of blocks are joined with the tiles by group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from tessera.constants import Q
from tessera.operators import kernel, parts
from tessera.operators.topk import FOUND, FOUND_STEP, TopK
from tessera.plans.storage import at_end, forget, kept, kept_once

TILE = "grp bigint, seq bigint, n int, ids binary, data binary, extra binary"
BLOCK = "grp bigint, n int, q_ids binary, q_data binary, q_take binary, q_step binary, candidates bigint, seen bigint, pruned bigint"
#: References of a tile, queries of a block, and counted bytes of blocks up to which they are broadcast.
TILE_ROWS, BLOCK_ROWS, BROADCAST_BYTES = 8192, 4096, 64 << 20
ALL = 1 << 60


def pack(assigned: DataFrame, group: str = "cluster_id", vector: Sequence[str] = tuple(Q), rows: int = TILE_ROWS) -> DataFrame:
    """TILE of references (ref_id, vector, fraud, group). The tiles of a group follow the ids in the order of seq."""
    columns = [F.col(group).cast("bigint").alias("grp"), F.col("ref_id").cast("bigint").alias("id"), F.col("fraud").cast("int").alias("extra"), *[F.col(v).cast("int").alias(v) for v in vector]]
    sorted_rows = assigned.select(*columns).repartitionByRange("grp", "id").sortWithinPartitions("grp", "id")
    names = list(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size, grp = 0, None
        seq = TaskContext.get().partitionId() << 32

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size, seq
            if held:
                ids, extra, data = (np.concatenate(c) for c in zip(*held, strict=True))
                yield pa.RecordBatch.from_pydict({"grp": pa.array([grp], "int64"), "seq": pa.array([seq], "int64"), "n": pa.array([len(ids)], "int32"), "ids": [ids.tobytes()], "data": [data.tobytes()], "extra": [extra.tobytes()]})
                held, size, seq = [], 0, seq + 1

        for batch in batches:
            groups = batch["grp"].to_numpy()
            ids, extra = batch["id"].to_numpy(), batch["extra"].to_numpy()
            data = np.stack([batch[v].to_numpy() for v in names], axis=1) if names else np.zeros((len(ids), 0), np.int32)
            ends = [*(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(groups)]
            at = 0
            for end in ends:
                if at < end and groups[at] != grp:
                    yield from flush()
                    grp = int(groups[at])
                while at < end:
                    upto = min(end, at + rows - size)
                    held.append((ids[at:upto], extra[at:upto], np.ascontiguousarray(data[at:upto])))
                    size, at = size + upto - at, upto
                    if size == rows:
                        yield from flush()
        yield from flush()

    return sorted_rows.mapInArrow(run, TILE)


def sizes(tiles: DataFrame) -> dict[int, int]:
    """References of each group; groups are bounded by a parameter of the index."""
    return {r["grp"]: r["n"] for r in tiles.groupBy("grp").agg(F.sum("n").alias("n")).collect()}


def before(tiles: DataFrame, cap: int) -> DataFrame:
    """The tiles before which fewer than `cap` references of their group lie, with their number, from the small columns of the
    tiles alone: a few rows a group."""
    upto = Window.partitionBy("grp").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    small = tiles.select("grp", "seq", "n").withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)).cast("bigint")).drop("n")
    return tiles.join(F.broadcast(small.where(F.col("before") < cap)), ["grp", "seq"])


class Tiles:
    """Tiles of an index that is opened once: their frame, the sizes of the groups, and the shard that a group's files are in."""

    def __init__(self, frame: DataFrame, shard_of: Callable[[int], int] | None = None):
        self.frame, self.shard_of = frame, shard_of
        self._sizes: dict[int, int] | None = None
        self._parts: dict[bool, parts.Parts] = {}

    @property
    def sizes(self) -> dict[int, int]:
        if self._sizes is None:
            self._sizes = sizes(self.frame)
        return self._sizes

    @property
    def count(self) -> int:
        return sum(self.sizes.values())

    def parts(self, dims: int, together: bool = False) -> parts.Parts:
        """The groups in parts that lie apart, made once: each by itself, or together."""
        if together not in self._parts:
            self._parts[together] = parts.divide(self.frame.select("grp", "n", "ids", "data", "extra"), dims, self.sizes, together)
        return self._parts[together]

    def preload(self) -> Tiles:
        """Has the executors hold the tiles, in memory or on their disks; a lost executor's are read again from the index."""
        self.frame = self.frame.persist(StorageLevel.MEMORY_AND_DISK)
        self._sizes = sizes(self.frame)
        return self

    def release(self) -> None:
        self.frame.unpersist()
        for made in self._parts.values():
            forget(made.frame)
        self._parts = {}


class Counters:
    """What searches count while they run: pairs of a query and a group that were scanned, candidates (references in these
    groups), and pairs of a query and a box that were seen and pruned. Spark observes them as the blocks are made."""

    NAMES = ("pairs", "candidates", "seen", "pruned")

    def __init__(self) -> None:
        self._watched: list[Observation] = []

    def watch(self, asked: DataFrame) -> DataFrame:
        self._watched.append(Observation())
        whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
        return asked.observe(self._watched[-1], *[whole(c).alias(name) for c, name in zip(("n", *self.NAMES[1:]), self.NAMES, strict=True)])

    @property
    def totals(self) -> dict[str, int]:
        """Sums over all searches so far, each of which has made its blocks."""
        return {name: sum(o.get[name] for o in self._watched) for name in self.NAMES}


def as_tiles(references: DataFrame | Tiles, group: str = "cluster_id", vector: Sequence[str] = tuple(Q)) -> Tiles:
    """Opened tiles of tiles, or of references with their group, which are packed and kept."""
    if isinstance(references, Tiles):
        return references
    # ranges are sampled before rows are dealt, and assigning rows to clusters again would cost more than reading them
    return Tiles(references if "grp" in references.columns else kept(pack(kept_once(references), group, vector)))


def blocks(queries: DataFrame, choose: Callable, vector: Sequence[str] = tuple(Q), query_id: str = "qid", more: Sequence[str] = ()) -> DataFrame:
    """BLOCK: the queries of each group that choose(matrix, arrays of `more`) -> (rows, groups, takes or None, steps or None,
    and maybe (candidates, seen, pruned)) picks. take is how many references of the group, in the order of ids, a query may
    scan; step orders the groups that a query asks. Counts of a batch go with its first block."""
    names = list(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(s, BLOCK_ROWS)
                ids, x = batch["qid"].to_numpy(), np.stack([batch[v].to_numpy() for v in names], axis=1).astype(np.int32)
                i, grp, take, step, *counted = choose(x, {m: batch[m].to_numpy(zero_copy_only=False) for m in more})
                sort = np.argsort(grp, kind="stable")
                i, grp = i[sort], grp[sort]
                take = np.full(len(i), ALL, np.int64) if take is None else np.asarray(take, np.int64)[sort]
                step = np.zeros(len(i), np.int32) if step is None else np.asarray(step, np.int32)[sort]
                cuts = np.r_[0, np.flatnonzero(np.diff(grp)) + 1, len(grp)].tolist() if len(grp) else [0]
                parts = [(int(grp[a]), b - a, ids[i[a:b]].tobytes(), x[i[a:b]].tobytes(), take[a:b].tobytes(), step[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                if counted and not parts:
                    parts = [(-1, 0, b"", b"", b"", b"")]  # nothing is asked, but it was looked for
                if parts:
                    g, n, *rest = zip(*parts, strict=True)
                    first = np.zeros((3, len(parts)), np.int64)
                    first[:, 0] = counted[0] if counted else 0
                    yield pa.RecordBatch.from_arrays([pa.array(g, "int64"), pa.array(n, "int32"), *[pa.array(r, "binary") for r in rest], *map(pa.array, first)], names=[c.split()[0] for c in BLOCK.split(", ")])

    columns = [F.col(query_id).cast("bigint").alias("qid"), *[F.col(v).cast("int").alias(v) for v in vector], *more]
    return queries.select(*columns).mapInArrow(run, BLOCK)


def of_probes(queries: DataFrame, probes: DataFrame, vector: Sequence[str] = tuple(Q), query_id: str = "qid") -> DataFrame:
    """BLOCK of probes (qid, cluster_id, optional take): for groups that are known as rows already."""
    take = F.col("take").cast("bigint") if "take" in probes.columns else F.lit(ALL).cast("bigint")
    wanted = probes.select("qid", F.col("cluster_id").cast("bigint").alias("grp"), take.alias("take")).join(queries.select(F.col(query_id).cast("bigint").alias("qid"), *vector), "qid")
    # a group that most queries ask is dealt over several tasks, too
    ranged = wanted.repartitionByRange("grp", "qid")
    return blocks(ranged, lambda x, m: (np.arange(len(x)), m["grp"], m["take"], None), vector, "qid", ("grp", "take"))


def _arrays(row, dims: int) -> tuple:
    return (np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["q_data"], np.int32).reshape(-1, dims), np.frombuffer(row["q_take"], np.int64), np.frombuffer(row["q_step"], np.int32))


def scan(index: Tiles, asked: DataFrame, dims: int, k: int, cap: int | None = None, with_step: bool = False, broadcast_bytes: int | None = None, counters: Counters | None = None, known: DataFrame | None = None) -> DataFrame:
    """FOUND: what is nearest to each query of the blocks `asked` among the tiles of its groups, at most k rows a query and task.

    cap: takes bind, none of which is larger; tiles that lie beyond it in their group meet no query. with_step: FOUND_STEP, k rows
    a query, step and task. Where the tiles' files are in folders of shards, only those of the groups that are asked are read. Where queries times references are many, groups are searched
    by parts that lie apart; then known (qid, d2), which was found in other groups, tells how far a query needs to look.
    """
    asked, capped = kept(counters.watch(asked) if counters else asked), cap is not None
    if not capped:
        wanted = {r["grp"]: r["n"] for r in asked.groupBy("grp").agg(F.sum("n").alias("n")).collect()}  # groups are bounded by a parameter
        if parts.fits(index.sizes, wanted):
            divided = index.parts(dims, together=not with_step and len(index.sizes) <= parts.MOST_TOGETHER)
            return parts.search(parts.rows_of(asked, dims, divided.together), divided, k, known, with_step)
    size = asked.agg(F.coalesce(F.sum(F.octet_length("q_ids") * 2 + F.octet_length("q_data") + F.octet_length("q_step")), F.lit(0))).first()[0]
    source, out = index.frame, FOUND_STEP if with_step else FOUND
    small = size <= (BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes)
    found: dict[int, list] = {}
    if small:
        for row in asked.collect():  # of counted size
            found.setdefault(row["grp"], []).append(_arrays(row, dims))
        source = source.where(F.col("grp").isin(sorted(found)) if found else F.lit(False))
        if index.shard_of and found:
            source = source.where(F.col("shard").isin(sorted({index.shard_of(g) for g in found})))
    source = before(source, cap) if capped else source.withColumn("before", F.lit(0).cast("bigint"))
    source = source.select("grp", "ids", "data", "extra", "before")
    if not small and capped:
        # the first tiles of each group may be few: then blocks meet them where they lie, however few groups there are
        source = kept(source)
        few = source.agg(F.coalesce(F.sum(F.octet_length("ids") + F.octet_length("data") + F.octet_length("extra")), F.lit(0))).first()[0] <= BROADCAST_BYTES
        tasks = max(source.sparkSession.sparkContext.defaultParallelism, int(source.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        source = asked.select("grp", "q_ids", "q_data", "q_take", "q_step").repartition(tasks).join(F.broadcast(source) if few else source, "grp")
    elif not small:
        # both sides are cut into pieces, so that a hot group can be divided
        source = asked.select("grp", "q_ids", "q_data", "q_take", "q_step").join(source, "grp")
    sent = source.sparkSession.sparkContext.broadcast({g: tuple(np.concatenate(c) for c in zip(*parts, strict=True)) for g, parts in found.items()})
    at_end(sent.destroy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, asked_by = TopK(k, with_step), sent.value
        for batch in batches:
            for s in range(batch.num_rows):
                row = batch.slice(s, 1).to_pylist()[0]
                q_ids, q_data, q_take, q_step = asked_by[row["grp"]] if small else _arrays(row, dims)
                ids, fraud = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["extra"], np.int32)
                data, take = np.frombuffer(row["data"], np.int32).reshape(len(ids), dims), None
                if capped:
                    # only queries that may scan rows of this tile, and rows that one of them may scan
                    take = np.clip(q_take - row["before"], 0, len(ids))
                    some = np.flatnonzero(take > 0)
                    q_ids, q_data, q_step, take = q_ids[some], q_data[some], q_step[some], take[some]
                    most = int(take.max(initial=0))
                    ids, data, take = ids[:most], data[:most], None if (take == most).all() else take
                for i, j, d in kernel.nearest(q_data, data, ids, k, take):
                    yield from held.add(q_ids[i], ids[j], d, fraud[j], q_step[i] if with_step else None)
        yield from held.rows()

    return source.mapInArrow(run, out)
