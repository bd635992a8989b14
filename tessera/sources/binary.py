"""References as binary files: a data source that reads ranges of rows, and a writer that commits whole files.

A file is a header, then in version 2 the centroids and the place where each cluster begins, then the vectors as 16-bit
whole numbers, row by row, then a byte for each label. All numbers are little-endian. A folder of such files is one table.
Rows have no ids: ref_id is a row's place in the table, files taken by name.
"""

from __future__ import annotations

import base64
import struct
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tessera.constants import DIMS, SCALE, Q
from tessera.operators.ivf import centroid_matrix

# Fixed values of the format: the first bytes, the versions without and with clusters, and the header's fields: version,
# dimensions, scale, rows, clusters, reserved.
MAGIC, PLAIN, CLUSTERED = b"RIN1", 1, 2
HEADER = struct.Struct("<4siiiqii")
NAME = "tessera-references"
#: Rows that one task reads, and rows of a batch.
PART_ROWS, BATCH_ROWS = 1 << 20, 1 << 16
_MOST_ROWS = (1 << 31) - 1


def _open(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


@dataclass
class Header:
    """What a file says about itself; begins (the first row of each cluster, and their end) is None without clusters."""

    version: int
    count: int
    clusters: int
    begins: np.ndarray | None
    centroids: np.ndarray | None

    @property
    def vectors_at(self) -> int:
        return HEADER.size + (self.clusters * DIMS * 2 + (self.clusters + 1) * 4 if self.clusters else 0)

    @property
    def labels_at(self) -> int:
        return self.vectors_at + self.count * DIMS * 2


def header_of(file, size: int) -> Header:
    """The header of an open file, or a ValueError that says what is wrong with it."""
    if size < HEADER.size:
        raise ValueError("the file is too small for references")
    magic, version, dims, scale, count, clusters, _ = HEADER.unpack(file.read(HEADER.size))
    if magic != MAGIC:
        raise ValueError("the file doesn't begin as references do")
    for what, found, known in (("version", version, (PLAIN, CLUSTERED)), ("dimensions", dims, (DIMS,)), ("scale", scale, (SCALE,))):
        if found not in known:
            raise ValueError(f"the file has {what} {found}, not {' or '.join(map(str, known))}")
    if not 0 <= count <= _MOST_ROWS:
        raise ValueError(f"the file has {count} rows")
    clusters = 0 if version == PLAIN else clusters
    if not 0 <= clusters <= _MOST_ROWS // DIMS:
        raise ValueError(f"the file has {clusters} clusters")
    made = Header(version, count, clusters, None, None)
    if size < made.labels_at + count:
        raise ValueError(f"the file has {size} bytes, not {made.labels_at + count}")
    if clusters:
        made.centroids = np.frombuffer(file.read(clusters * DIMS * 2), "<i2").reshape(clusters, DIMS)
        made.begins = np.frombuffer(file.read((clusters + 1) * 4), "<i4").astype(np.int64)
        if made.begins[0] != 0 or made.begins[-1] != count or (np.diff(made.begins) < 0).any():
            raise ValueError("the clusters' beginnings don't go from 0 to the number of rows")
    return made


def _files(uri: str) -> list[tuple[str, int]]:
    """(path, size) of the files of a path, which is one or a folder, by name."""
    from pyarrow.fs import FileSelector, FileType

    fs, path = _open(uri)
    info = fs.get_file_info(path)
    if info.type == FileType.NotFound:
        raise FileNotFoundError(uri)
    found = [info] if info.type == FileType.File else [f for f in fs.get_file_info(FileSelector(path)) if f.type == FileType.File and not f.base_name.startswith(("_", "."))]
    return sorted((f.path, f.size) for f in found)


def headers(uri: str) -> list[tuple[str, Header]]:
    fs, _ = _open(uri)
    out = []
    for path, size in _files(uri):
        with fs.open_input_file(path) as f:
            out.append((path, header_of(f, size)))
    return out


@dataclass
class _Rows(InputPartition):
    path: str
    vectors_at: int
    labels_at: int
    first: int
    last: int
    base: int
    begins: bytes  # of the clusters that the rows are in
    cluster: int  # the first of them, -1 without clusters


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri, wanted = options["path"], options.get("clusters")
        self.clusters = None if wanted is None else {int(x) for x in wanted.split(",") if x}
        self.part_rows = int(options.get("partrows", PART_ROWS))

    def partitions(self) -> Sequence[InputPartition]:
        out, base = [], 0
        for path, h in headers(self.uri):
            spans = [(0, h.count)]
            if self.clusters is not None:
                if h.begins is None:
                    raise ValueError("clusters are asked of a file that has none")
                # neighbouring clusters are read together
                spans = []
                for c in sorted(self.clusters & set(range(h.clusters))):
                    a, b = int(h.begins[c]), int(h.begins[c + 1])
                    if spans and spans[-1][1] == a:
                        spans[-1] = (spans[-1][0], b)
                    elif a < b:
                        spans.append((a, b))
            for a, b in spans:
                for s in range(a, b, self.part_rows):
                    e, begins, cluster = min(b, s + self.part_rows), b"", -1
                    if h.begins is not None:
                        cluster = int(np.searchsorted(h.begins, s, side="right")) - 1
                        begins = h.begins[cluster + 1 : int(np.searchsorted(h.begins, e, side="left"))].tobytes()
                    out.append(_Rows(path, h.vectors_at, h.labels_at, s, e, base, begins, cluster))
            base += h.count
        return out or [_Rows("", 0, 0, 0, 0, 0, b"", -1)]

    def read(self, p: _Rows) -> Iterator[pa.RecordBatch]:
        if p.first == p.last:
            return
        fs, _ = _open(self.uri)
        begins = np.frombuffer(p.begins, np.int64)
        with fs.open_input_file(p.path) as f:
            for s in range(p.first, p.last, BATCH_ROWS):
                n = min(BATCH_ROWS, p.last - s)
                f.seek(p.vectors_at + s * DIMS * 2)
                x = np.frombuffer(f.read(n * DIMS * 2), "<i2").reshape(n, DIMS).astype(np.int32)
                f.seek(p.labels_at + s)
                fraud = (np.frombuffer(f.read(n), np.uint8) == 1).astype(np.int32)
                rows = np.arange(s, s + n, dtype=np.int64)
                cluster = pa.nulls(n, "int64") if p.cluster < 0 else pa.array(p.cluster + np.searchsorted(begins, rows, side="right"))
                yield pa.RecordBatch.from_arrays([pa.array(p.base + rows), *[pa.array(np.ascontiguousarray(x[:, d])) for d in range(DIMS)], pa.array(fraud), cluster], names=["ref_id", *Q, "fraud", "cluster_id"])


@dataclass
class _Written(WriterCommitMessage):
    temp: str
    rows: int


class _Writer(DataSourceArrowWriter):
    """Every task writes one whole file under a temporary name; the driver renames them once all tasks are through.

    Vectors go to a file of their own while rows arrive, as the header has their number; labels, a byte a row, wait.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.uri, self.overwrite = options["path"], overwrite
        self.job, raw = uuid.uuid4().hex, options.get("centroids")
        self.centroids = None if raw is None else np.frombuffer(base64.b64decode(raw), "<i2").reshape(-1, DIMS)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        fs, root = _open(self.uri)
        temp = f"{root}/_{self.job}-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        fs.create_dir(root, recursive=True)
        labels, sizes, rows, last = [], np.zeros(0 if self.centroids is None else len(self.centroids), np.int64), 0, -1
        with fs.open_output_stream(temp + ".rows") as f:
            for b in iterator:
                x = np.stack([b[q].to_numpy(zero_copy_only=False) for q in Q], axis=1) if b.num_rows else np.zeros((0, DIMS))
                if len(x) and (np.abs(x) > SCALE).any():
                    raise ValueError(f"a vector is beyond {SCALE}")
                f.write(x.astype("<i2").tobytes())
                labels.append((b["fraud"].to_numpy(zero_copy_only=False) == 1).astype(np.uint8).tobytes())
                rows += len(x)
                if self.centroids is not None and len(x):
                    c = b["cluster_id"].to_numpy(zero_copy_only=False)
                    if c.min() < 0 or c.max() >= len(sizes) or c[0] < last or (np.diff(c) < 0).any():
                        raise ValueError("rows are not in the order of their clusters")
                    sizes += np.bincount(c.astype(np.int64), minlength=len(sizes))
                    last = c[-1]
        if rows > _MOST_ROWS:
            raise ValueError(f"{rows} rows are too many for one file")
        clustered = self.centroids is not None
        with fs.open_output_stream(temp) as f:
            f.write(HEADER.pack(MAGIC, CLUSTERED if clustered else PLAIN, DIMS, SCALE, rows, len(sizes), 0))
            if clustered:
                f.write(self.centroids.astype("<i2").tobytes() + np.r_[0, np.cumsum(sizes)].astype("<i4").tobytes())
            with fs.open_input_stream(temp + ".rows") as g:
                while part := g.read(1 << 22):
                    f.write(part)
            for part in labels:
                f.write(part)
        fs.delete_file(temp + ".rows")
        return _Written(temp, rows)

    def commit(self, messages: list) -> None:
        from pyarrow.fs import FileSelector, FileType

        fs, root = _open(self.uri)
        done = sorted((m for m in messages if m is not None), key=lambda m: m.temp.split("-")[-2])
        old = [f.path for f in fs.get_file_info(FileSelector(root)) if f.type == FileType.File and f.base_name.endswith(".bin")]
        if old and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(self.uri)
        for path in old:
            fs.delete_file(path)
        # a table without rows is one file without rows
        filled = [m for m in done if m.rows] or done[:1]
        for i, m in enumerate(filled):
            fs.move(m.temp, f"{root}/part-{i:06d}.bin")
        self._sweep()

    def abort(self, messages: list) -> None:
        self._sweep()

    def _sweep(self) -> None:
        """What tasks that failed or ran twice have left."""
        from pyarrow.fs import FileSelector

        fs, root = _open(self.uri)
        for f in fs.get_file_info(FileSelector(root, allow_not_found=True)):
            if f.base_name.startswith(f"_{self.job}"):
                fs.delete_file(f.path)


class BinaryReferences(DataSource):
    """format("tessera-references"): path, and for reading `clusters` (numbers with commas: only their rows are read)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return ", ".join(["ref_id bigint", *(f"{q} int" for q in Q), "fraud int", "cluster_id bigint"])

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options), overwrite)


def read(spark: SparkSession, path: str, clusters: Sequence[int] | None = None) -> DataFrame:
    """(ref_id, q0.., fraud, cluster_id) of a file or a folder; cluster_id is null in version 1. Damaged files are refused
    before a row is read."""
    headers(path)
    spark.dataSource.register(BinaryReferences)
    reader = spark.read.format(NAME)
    if clusters is not None:
        reader = reader.option("clusters", ",".join(map(str, clusters)))
    return reader.load(path)


def read_centroids(spark: SparkSession, path: str) -> DataFrame:
    """(cluster_id, q0..) of version 2; all files of a folder have the same."""
    found = headers(path)
    if not found or found[0][1].centroids is None or any(h.centroids is None or (h.centroids != found[0][1].centroids).any() for _, h in found):
        raise ValueError("the files have not one set of centroids")
    rows = [(i, *map(int, c)) for i, c in enumerate(found[0][1].centroids)]
    return spark.createDataFrame(rows, ", ".join(["cluster_id bigint", *(f"{q} int" for q in Q)]))


def write(references: DataFrame, path: str, files: int | None = None, mode: str = "append") -> None:
    """Version 1 of (ref_id, q0.., fraud), in the order of ref_id, so that ids are kept where they are 0, 1, 2, ..."""
    references.sparkSession.dataSource.register(BinaryReferences)
    rows = references.select("ref_id", *[F.col(q).cast("int").alias(q) for q in Q], F.col("fraud").cast("int").alias("fraud"), F.lit(None).cast("bigint").alias("cluster_id"))
    ranged = rows.repartitionByRange(files, "ref_id") if files else rows.repartitionByRange("ref_id")
    ranged.sortWithinPartitions("ref_id").write.format(NAME).mode(mode).save(path)


def write_clustered(assigned: DataFrame, centroids: DataFrame, path: str, files: int | None = None, mode: str = "append") -> None:
    """Version 2 of (ref_id, q0.., fraud, cluster_id) with its centroids, whose ids must be 0, 1, 2, ..."""
    assigned.sparkSession.dataSource.register(BinaryReferences)
    ids, c = centroid_matrix(centroids)
    if (ids != np.arange(len(ids))).any():
        raise ValueError("clusters must be numbered from 0 on")
    told = base64.b64encode(c.astype("<i2").tobytes()).decode()
    rows = assigned.select("ref_id", *[F.col(q).cast("int").alias(q) for q in Q], F.col("fraud").cast("int").alias("fraud"), "cluster_id")
    ranged = rows.repartitionByRange(files, "cluster_id", "ref_id") if files else rows.repartitionByRange("cluster_id", "ref_id")
    ranged.sortWithinPartitions("cluster_id", "ref_id").write.format(NAME).option("centroids", told).mode(mode).save(path)
