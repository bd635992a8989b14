"""A Merkle manifest of a dataset: a leaf for each row, a tree for each group, one tree over the groups' roots.

Leaves are digests of the rows' fields. They are sorted by group and order column over range partitions and numbered by
counting, so that no task holds a group. Every `fanout ** levels` leaves in a row are an aligned block: a contiguous matrix
of 64 hexadecimal bytes a leaf, which is reshaped by the fanout and hashed row by row, level after level. Roots of blocks
are the leaves of the next matrix, until each group has one node; the groups' roots are one more such tree. Then the way
back: every node of an upper matrix hands the siblings above it down to its block, and inside a block the siblings of all
rows are found by arithmetic on their index.

A block is one row of a stored table (matrices as bytes), at most `fanout ** levels` leaves long, and all trees above are
stored tables too: a lost executor costs the tasks that it had. The trees above the first have one row for each block.

Defined cases: a null field counts as -, an empty text as 0:; rows of one group and order value (also null) are ordered by
their digest, and equal ones each have a leaf; a null order value comes first, as does the null group; the root of a group
of one row is its leaf, and a row without any sibling has the digest of nothing as proof; an empty table gives no rows;
columns that are no field are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, forget, stored

HEX = 64
FANOUT, LEVELS = 2, 12
#: Files of one tree whose rows are summed in one window, and counted bytes up to which a table of upper nodes is broadcast.
_CHUNK, BROADCAST_BYTES = 4096, 32 << 20
#: Packed rows of a block: idx is the block's number in its tree, total the number of all leaves of the tree.
_BLOCK = "tree string, idx bigint, total bigint, n int, root binary, leaves binary"
_DIGITS = np.frombuffer(b"0123456789abcdef", np.uint8)


def leaf_of(fields: Sequence[Column]) -> Column:
    """The digest of a row: each field as its number of UTF-8 bytes, a colon and its text, or - for null."""
    text = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def _hashed(rows: np.ndarray, last: int) -> np.ndarray:
    """Digests of the rows of a matrix, as hexadecimal bytes; of the last row only the first `last` bytes count."""
    out = bytearray()
    for i in range(len(rows)):
        out += hashlib.sha256(rows[i] if i + 1 < len(rows) else rows[i, :last]).hexdigest().encode()
    return np.frombuffer(out, np.uint8).reshape(-1, HEX)


def _level(nodes: np.ndarray, fanout: int) -> np.ndarray:
    """The nodes above: the matrix reshaped by the fanout, its rows hashed."""
    n, runs = len(nodes), -(-len(nodes) // fanout)
    wide = np.zeros((runs * fanout, HEX), np.uint8)
    wide[:n] = nodes
    return _hashed(wide.reshape(runs, fanout * HEX), (n - (runs - 1) * fanout) * HEX)


def _climbed(nodes: np.ndarray, depth: int, fanout: int) -> list[np.ndarray]:
    """The matrices of all levels, from the leaves to the block's root."""
    out = [nodes]
    for _ in range(depth):
        out.append(_level(out[-1], fanout))
    return out


def _depth(total: int, levels: int, fanout: int) -> int:
    """Levels of a block: all, or in a tree that is no larger than one block as many as it takes to have one node."""
    depth = 0
    while depth < levels and total > 1:
        depth, total = depth + 1, -(-total // fanout)
    return depth


def _siblings(matrices: list[np.ndarray], fanout: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Level by level, for each leaf of the block: (indices of its run's nodes, which of them there are, its own place)."""
    at = np.arange(len(matrices[0]))
    for nodes in matrices[:-1]:
        run = at // fanout
        members = run[:, None] * fanout + np.arange(fanout)[None, :]
        yield members, members < len(nodes), at - run * fanout
        at = run


def proofs(matrices: list[np.ndarray], fanout: int) -> list[bytes]:
    """For each leaf of the block its siblings' digests, level by level, left to right."""
    wide, there = [np.zeros((len(matrices[0]), 0), np.uint8)], [np.zeros((len(matrices[0]), 0), bool)]
    for nodes, (members, exists, own) in zip(matrices, _siblings(matrices, fanout), strict=False):
        other = np.arange(fanout)[None, :] != own[:, None]
        # own places are cut out, which leaves fanout - 1 columns in every row
        idx, ok = (x[other].reshape(len(members), fanout - 1) for x in (members, exists))
        wide.append(nodes[np.minimum(idx, len(nodes) - 1)].reshape(len(members), -1))
        there.append(np.repeat(ok, HEX, axis=1))
    w, t = np.concatenate(wide, axis=1), np.concatenate(there, axis=1)
    whole = t.all(axis=1)
    return [(w[i] if whole[i] else w[i][t[i]]).tobytes() for i in range(len(w))]


def folded(matrices: list[np.ndarray], leaves: np.ndarray, fanout: int) -> np.ndarray:
    """What each row's own leaf (maybe another one than in the block) and its siblings in the block lead up to."""
    now = leaves
    for nodes, (members, exists, own) in zip(matrices, _siblings(matrices, fanout), strict=False):
        run = nodes[np.minimum(members, len(nodes) - 1)]
        run[np.arange(len(run)), own] = now
        run, sizes = run.reshape(len(run), -1), exists.sum(axis=1) * HEX
        now = np.frombuffer("".join(hashlib.sha256(r[:s]).hexdigest() for r, s in zip(run, sizes, strict=True)).encode(), np.uint8).reshape(-1, HEX)
    return now


def fold(digest: bytes, above: bytes, idx: int, total: int, fanout: int) -> bytes:
    """The root that a node (the idx-th of total) and the siblings above it lead to."""
    at = 0
    while total > 1:
        run = idx // fanout
        own, size = idx - run * fanout, min(fanout, total - run * fanout)
        left, right = above[at : at + own * HEX], above[at + own * HEX : at + (size - 1) * HEX]
        digest = hashlib.sha256(left + digest + right).hexdigest().encode()
        at, idx, total = at + (size - 1) * HEX, run, -(-total // fanout)
    return digest


def _hex(raw: np.ndarray) -> np.ndarray:
    """(n, 32) bytes as (n, 64) hexadecimal ones."""
    return _DIGITS[np.stack([raw >> 4, raw & 15], axis=2).reshape(len(raw), 2 * raw.shape[1])]


def _matrix(raw: bytes) -> np.ndarray:
    return _hex(np.frombuffer(raw, np.uint8).reshape(-1, HEX // 2))


def _meet(big: DataFrame, small: DataFrame, keys: list[str], width: int) -> DataFrame:
    """big joined with small, a stored table of about width bytes a row, which is broadcast up to a counted size."""
    return big.join(F.broadcast(small) if small.count() * width <= BROADCAST_BYTES else small, keys)


def _before(runs: DataFrame) -> DataFrame:
    """(tree, part, file, first, before, total): the rows of a tree in the files before, and in all. Files are summed by
    chunks of parts, and the chunks' sums then, so that a window holds at most _CHUNK parts, or one row a chunk."""
    runs = runs.withColumn("chunk", F.floor(F.col("part") / _CHUNK))
    upto = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    chunks = runs.groupBy("tree", "chunk").agg(F.sum("n").alias("in_chunk")).withColumns({
        "chunks_before": F.coalesce(F.sum("in_chunk").over(upto("tree").orderBy("chunk")), F.lit(0)), "total": F.sum("in_chunk").over(Window.partitionBy("tree")),
    })
    inside = F.coalesce(F.sum("n").over(upto("tree", "chunk").orderBy("part", "file")), F.lit(0))
    return runs.withColumn("inside", inside).join(chunks, ["tree", "chunk"]).select("tree", "part", "file", "first", (F.col("inside") + F.col("chunks_before")).alias("before"), "total")


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows (tree, ord, leaf, ...) with pos, their number in the tree in the order of ord and leaf, from 0, and total.

    The rows are written in order, a file for each range. A row's place in its file, less the place where its tree begins
    there, and the rows of the tree in files before make its number.
    """
    # equal rows are told apart by where they were read, so that a range can be cut among them
    leaves = stored(rows, "merkle-leaves")
    keys = ["tree", "ord", "leaf", "salt"]
    ranged = leaves.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered = stored(ranged.drop("salt").withColumn("part", F.spark_partition_id()), "merkle-ordered")
    forget(leaves)
    at = ordered.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    runs = stored(at.groupBy("tree", "part", "file").agg(F.count("*").alias("n"), F.min("row").alias("first")), "merkle-runs")  # a row for each file and tree in it
    before = stored(_before(runs), "merkle-before")
    return _meet(at, before, ["tree", "part", "file"], 200).withColumn("pos", F.col("row") - F.col("first") + F.col("before")).drop("part", "file", "row", "first", "before")


def _packed(nodes: DataFrame, levels: int, fanout: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """Blocks (_BLOCK) of nodes (tree, pos, total, leaf: 32 bytes), and with extra: ids (ord) and claimed (other leaves)."""
    width, with_ids = fanout**levels, "ord" in extra

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("pos").combine_chunks()
        raw = b"".join(t["leaf"].to_pylist())
        total = t["total"][0].as_py()
        out = {
            "tree": t["tree"][:1], "idx": t["block"][:1], "total": t["total"][:1], "n": pa.array([len(t)], "int32"),
            "root": pa.array([bytes.fromhex(_climbed(_matrix(raw), _depth(total, levels, fanout), fanout)[-1].tobytes().decode())]), "leaves": pa.array([raw]),
        }
        if with_ids:
            claimed = t["claimed"].to_pylist()
            out |= {"ids": pa.array([t["ord"].to_pylist()], pa.list_(t["ord"].type)), "changed": pa.array([bytes(c is not None for c in claimed)]), "claimed": pa.array([b"".join(c for c in claimed if c is not None)])}
        return pa.table(out)

    schema = _BLOCK + (f", ids array<{nodes.schema['ord'].dataType.simpleString()}>, changed binary, claimed binary" if with_ids else "")
    blocks = nodes.withColumn("block", F.floor(F.col("pos") / width).cast("bigint"))
    return blocks.groupBy("tree", "block").applyInArrow(pack, schema)


def _tree(nodes: DataFrame, levels: int, fanout: int) -> DataFrame:
    """A stored table (tree, pos, total, above, top) of nodes (tree, pos, total, leaf): the siblings above each, and its tree's root."""
    packed = stored(_packed(nodes, levels, fanout), "merkle-nodes")
    met = _under(packed, levels, fanout)

    def hand_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                own = proofs(_climbed(_matrix(r["leaves"]), _depth(r["total"], levels, fanout), fanout), fanout)
                n, first = len(own), r["idx"] * fanout**levels
                yield pa.RecordBatch.from_pydict({
                    "tree": [r["tree"]] * n, "pos": pa.array(range(first, first + n), "int64"), "total": [r["total"]] * n, "above": [p + r["above"] for p in own], "top": [r["top"]] * n,
                })

    return stored(met.mapInArrow(hand_down, "tree string, pos bigint, total bigint, above binary, top binary"), "merkle-above")


def _under(packed: DataFrame, levels: int, fanout: int) -> DataFrame:
    """packed (stored) with above and top of each block, from the trees over the blocks."""
    width = fanout**levels
    if (packed.agg(F.max("total")).first()[0] or 0) <= width:
        return packed.withColumns({"above": F.lit(b""), "top": F.col("root")})
    roots = packed.select("tree", F.col("idx").alias("pos"), F.ceil(F.col("total") / width).cast("bigint").alias("total"), F.col("root").alias("leaf"))
    upper = _tree(roots, levels, fanout).select("tree", F.col("pos").alias("idx"), "above", "top")
    return _meet(packed, upper, ["tree", "idx"], 200 + HEX * 40 * fanout)


def manifest(docs: DataFrame, fields: Sequence[str], group: str, order: str, fanout: int = FANOUT, levels: int = LEVELS, claimed: Column | None = None) -> DataFrame:
    """A row for each of docs: order (under its own name), tree_group, position and size (in its group), leaf, subroot,
    root, proof (the siblings' digests, level by level through the group's tree and the one over the groups, left to
    right, as hexadecimal bytes), folded_root: what the claimed leaf (a column of docs; where it is null, the row's own)
    and the proof lead to, and verified: that this is the root."""
    if fanout < 2 or levels < 1:
        raise ValueError("a tree needs a fanout of 2 and blocks of 1 level at least")
    raw = lambda c: F.unhex(c)
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), column(group).cast("string")), F.lit("")).alias("tree"), column(order).alias("ord"), raw(leaf_of([column(f) for f in fields])).alias("leaf"),
        (F.lit(None).cast("binary") if claimed is None else raw(claimed)).alias("claimed"),
    )
    packed = stored(_packed(_numbered(rows), levels, fanout, ("ord", "claimed")), "merkle-blocks")
    under = stored(_under(packed, levels, fanout), "merkle-under")
    groups = under.where("idx = 0").select("tree", "top")
    ranked = stored(_numbered(groups.select(F.lit("").alias("tree"), F.col("tree").alias("ord"), F.col("top").alias("leaf"))), "merkle-groups")
    over = _tree(ranked, levels, fanout)
    named = stored(ranked.join(over, ["tree", "pos", "total"]).select(F.col("ord").alias("tree"), F.col("pos").alias("g_pos"), F.col("total").alias("g_total"), F.col("above").alias("g_above"), F.col("top").alias("g_top")), "merkle-named")
    kind = docs.schema[order].dataType.simpleString()

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch[c][i] for c in batch.schema.names}
                ids, r = r.pop("ids").values, {c: x.as_py() for c, x in r.items()}
                matrices = _climbed(_matrix(r["leaves"]), _depth(r["total"], levels, fanout), fanout)
                n, first, changed = r["n"], r["idx"] * fanout**levels, np.frombuffer(r["changed"], bool)
                mine = matrices[0].copy()
                mine[changed] = _matrix(r["claimed"])
                inside = folded(matrices, mine, fanout)
                at, blocks = r["idx"], -(-r["total"] // fanout**levels)
                tops = [fold(fold(x.tobytes(), r["above"], at, blocks, fanout), r["g_above"], r["g_pos"], r["g_total"], fanout) for x in inside]
                rest, root = r["above"] + r["g_above"], r["g_top"].hex()
                text = [x.tobytes().decode() for x in matrices[0]]
                found = [t.decode() for t in tops]
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array([r["tree"][1:] if r["tree"] else None] * n, "string"), pa.array(range(first, first + n), "int64"), pa.array([r["total"]] * n, "int64"), pa.array(text, "string"),
                    pa.array([r["top"].hex()] * n, "string"), pa.array([root] * n, "string"), pa.array([p + rest for p in proofs(matrices, fanout)], "binary"), pa.array(found, "string"), pa.array([t == root for t in found], "bool"),
                ], names=[f"c{j}" for j in range(10)])

    names = (order, "tree_group", "position", "size", "leaf", "subroot", "root", "proof", "folded_root", "verified")
    kinds = (kind, "string", "bigint", "bigint", "string", "string", "string", "binary", "string", "boolean")
    met = _meet(under, named, ["tree"], 200 + HEX * 40 * fanout)
    return met.mapInArrow(prove, ", ".join(f"c{j} {k}" for j, k in enumerate(kinds))).toDF(*names)
