"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder of this machine only where it is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    held = getattr(spark.sparkContext, "_slidespark_dir", None)
    if held is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        held = spark.sparkContext._slidespark_dir = "file://" + tempfile.mkdtemp(prefix="slidespark-")
    return held


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage at a copy in the shared folder; partitions and their order stay."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


_made = threading.local()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_writers = threading.Lock()


@contextmanager
def _shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Until the last writer leaves, Spark deletes the shuffle files of a query at its end, not when the driver happens to collect garbage."""
    state = spark.sparkContext.__dict__.setdefault("_slidespark_writers", {})
    key = spark._jsparkSession.sessionUUID()
    with _writers:
        n, old = state.get(key) or (0, spark.conf.get(_CLEANUP, None))
        state[key] = n + 1, old
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _writers:
            n, old = state.pop(key)
            if n > 1:
                state[key] = n - 1, old
            elif old is None:
                spark.conf.unset(_CLEANUP)
            else:
                spark.conf.set(_CLEANUP, old)


def materialize(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it back, so that lost executors never cost a recomputation; shuffle files of the writing go."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/slidespark-{uuid.uuid4().hex}"
    with _shuffles_deleted(spark):
        df.write.parquet(path)
    held = spark.sparkContext.__dict__.setdefault("_slidespark_tables", set())
    held.add(path)
    if (made := getattr(_made, "paths", None)) is not None:
        made.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._slidespark_path = path
    return out


def grown(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: it is sorted and shuffled, never gathered in the driver to be broadcast.

    Spark measures sizes after compression, and rows of a few small numbers are up to fifty times larger in memory.
    """
    return df.hint("merge")


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    spark.sparkContext.__dict__.setdefault("_slidespark_tables", set()).discard(path)


def release(*tables: DataFrame) -> None:
    """Deletes tables that ``materialize`` gave and that no plan still reads."""
    for t in tables:
        if path := getattr(t, "_slidespark_path", None):
            _delete(t.sparkSession, path)


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``make`` gives, written; what this thread materialized on the way is deleted."""
    outer, _made.paths = getattr(_made, "paths", None), []
    try:
        out = materialize(make())
        for path in _made.paths:
            if path != out._slidespark_path and path in spark.sparkContext._slidespark_tables:
                _delete(spark, path)
    finally:
        _made.paths = outer
    if outer is not None:
        outer.append(out._slidespark_path)
    return out


def release_all(spark: SparkSession) -> None:
    """Deletes all tables that are left, at the end of a program."""
    for path in list(getattr(spark.sparkContext, "_slidespark_tables", ())):
        _delete(spark, path)
