"""Where intermediate results go, and when they go away."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_here = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; where it is unset, a local one in local mode only."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        # the setting can't be changed in a running session, so the context keeps it
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


def kept(df: DataFrame, lasting: bool = False) -> DataFrame:
    """df, written to the shared folder and read again: a lost executor doesn't cost the work before it. What is lasting
    outlives the scratch that it was kept in."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-core/{uuid.uuid4().hex}"
    if not lasting:
        at_end(lambda: remove(spark, path))
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.kept_at = path
    return back


def kept_once(df: DataFrame) -> DataFrame:
    """df itself where it is a kept table, else df kept: for what is read several times and is dear to compute."""
    return df if "kept_at" in df.__dict__ else kept(df)


def forget(*tables: DataFrame) -> None:
    """Deletes kept tables that nothing reads any more; others are left alone."""
    for t in tables:
        path = t.__dict__.pop("kept_at", None)
        if path:
            remove(t.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, whatever file system it is on; one that is gone already is no error."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def at_end(release: Callable[[], None]) -> None:
    """Has release called at the end of this thread's innermost scratch, if there is one."""
    scopes = getattr(_here, "scopes", None)
    if scopes:
        scopes[-1].append(release)


@contextmanager
def scratch() -> Iterator[None]:
    """What this thread keeps or broadcasts inside goes away at the end, also after an error: results must have been written
    by then."""
    scopes = _here.__dict__.setdefault("scopes", [])
    scopes.append([])
    try:
        yield
    finally:
        for release in scopes.pop():
            release()
