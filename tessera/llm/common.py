"""Helpers that the training-data operators share: tables, the shared folder, batches."""

from __future__ import annotations

import gc
import os
import tempfile
import threading
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

#: Characters of text that a Python worker turns into objects at a time.
BATCH_CHARS = 1 << 20
_inside = threading.local()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    """The column of that name, whatever characters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, from spark.checkpoint.dir.

    Where that setting is missing, a local one is made and set in local mode, as in tests; a cluster must name one.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        # the setting can't be changed in a running session, so the context keeps it
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        context.setCheckpointDir(found)
    return found


def fresh_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that no other step uses."""
    return f"{shared_dir(spark).rstrip('/')}/tessera/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """df, written to the shared folder and read again: later failures don't recompute it."""
    path = fresh_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.stored_at = path
    if getattr(_inside, "paths", None) is not None:
        _inside.paths.append(path)
    return back


@contextmanager
def scratch(spark: SparkSession) -> Iterator[set]:
    """Deletes what is stored inside once it ends, except the paths that are put into the set that it gives."""
    kept: set = set()
    outer, _inside.paths = getattr(_inside, "paths", None), []
    try:
        yield kept
    finally:
        paths, _inside.paths = _inside.paths, outer
        for path in paths:
            if path not in kept:
                remove(spark, path)
            elif outer is not None:
                outer.append(path)


def release(spark: SparkSession) -> None:
    """Has the driver drop what no table refers to any more, above all the shuffle files of tables that are stored now."""
    # listeners hold the end of the last query, and so all that it shuffled, until another query runs
    spark.range(1).collect()
    gc.collect()
    time.sleep(0.5)  # until the JVM has heard what Python has dropped
    spark.sparkContext._jvm.System.gc()


def forget(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more; others are left alone."""
    for t in tables:
        path = t.__dict__.pop("stored_at", None)
        if path:
            remove(t.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared storage, whatever file system it is on."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def sub_batches(frames: Iterable[pd.DataFrame], text: str, chars: int = BATCH_CHARS) -> Iterator[pd.DataFrame]:
    """The same rows in order, in pieces of about so many characters (a longer text is a piece of its own)."""
    for frame in frames:
        if not len(frame):
            continue
        sizes = frame[text].str.len().fillna(0).astype("int64").to_numpy()
        piece = (sizes.cumsum() - sizes) // chars
        for _, part in frame.groupby(piece, sort=False):
            yield part


def with_columns(docs: DataFrame, text_col: str, work: Callable, schema: str, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with the columns of work(texts) -> dict of columns; null texts arrive as ''.

    The columns of docs pass as Arrow data, so that whole numbers beside nulls stay what they are, and texts become
    Python objects BATCH_CHARS at a time. A column of docs whose name is in the schema gives way.
    """
    made = docs.sparkSession.createDataFrame([], schema).schema
    kept = [f for f in docs.schema if (keep is None or f.name in keep) and f.name not in made.names]
    arrow = to_arrow_schema(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _pieces(pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False), BATCH_CHARS):
                part = batch.slice(a, b - a)
                found = work(pc.fill_null(part.column(0), "").to_pylist())
                columns = [pa.array(list(found[f.name]), type=f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *columns], names=names)

    # columns are numbered on the way, since a name with dots or quotes can't be passed to a function
    names = [f"c{i}" for i in range(len(kept) + len(arrow))]
    rows = docs.select(column(text_col).cast("string").alias("t"), *[column(f.name).alias(n) for f, n in zip(kept, names, strict=False)])
    out = rows.mapInArrow(run, StructType([StructField(n, f.dataType) for f, n in zip([*kept, *made.fields], names, strict=True)]))
    return out.toDF(*[f.name for f in kept], *made.names)


def per_text(docs: DataFrame, id_col: str, text_col: str, work: Callable, schema: str) -> DataFrame:
    """The id of every row, and the columns of work(texts)."""
    return with_columns(docs, text_col, work, schema, [id_col])


def _pieces(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about so many bytes; a larger row is a range of its own."""
    if not len(sizes):
        return
    piece = (np.cumsum(sizes, dtype=np.int64) - sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(sizes)]
    yield from zip(cuts[:-1], cuts[1:], strict=True)


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    folder = os.environ.get("TESSERA_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
