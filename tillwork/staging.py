"""Shared-folder staging, and joins of per-group values whose size is checked first.

A per-group table (limits, latest years, header mappings) is written once to the folder that the
session names in ``spark.checkpoint.dir``. That cuts its lineage, survives lost executors, and
gives its true size, which decides how it is joined back to the big table.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 32 * 1024 * 1024

_opened: ContextVar[list[str] | None] = ContextVar("staged", default=None)


@lru_cache(maxsize=1)
def _test_folder() -> str:
    folder = tempfile.mkdtemp(prefix="tillwork-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can read; only local sessions may fall back to their own disk."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return _test_folder()
    raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path; all paths of one application lie in one folder, which may go when it ends."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    path = new_path(df.sparkSession, name)
    if (opened := _opened.get()) is not None:
        opened.append(path)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Delete on exit what is staged inside, once the results that read it are written.

    For micro-batches, whose application does not end.
    """
    token = _opened.set([])
    try:
        yield
    finally:
        paths = _opened.get()
        _opened.reset(token)
        for path in paths:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries made and run inside leave no shuffle files behind.

    For large shuffles whose result is collected once: else their files stay on the disks until the driver's next garbage collection.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def stage_measured(df: DataFrame, name: str, counted: Column | None = None) -> tuple[DataFrame, int]:
    """Like ``stage``; also returns the size in bytes of the rows, or of the ``counted`` ones, counted while they are written."""
    size = Observation()
    row_bytes = F.octet_length(F.to_json(F.struct("*"))) + 8 * len(df.columns)
    if counted is not None:
        row_bytes = F.when(counted, row_bytes)
    measured = df.observe(size, F.coalesce(F.sum(row_bytes), F.lit(0)).alias("bytes"))
    return stage(measured, name), size.get["bytes"]


def attach(
    rows: DataFrame,
    values: DataFrame,
    on: Sequence[str],
    how: str = "left",
    size: int | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
    *,
    null_safe: bool = False,
) -> DataFrame:
    """Join a table with one row per group to the rows of those groups.

    Up to ``broadcast_bytes`` the table is broadcast, so the rows are not shuffled. Above that it is
    a plain shuffled join, in which the engine splits the partitions of heavy keys at run time
    (``spark.sql.adaptive.skewJoin``): only what a heavy key needs is read more than once.
    ``size`` skips staging when the caller has measured it. With ``null_safe`` a NULL key is a key like others.
    """
    on = list(on)
    if size is None:
        values, size = stage_measured(values, "attach")
    if not null_safe:
        return rows.join(_hinted(values, size, broadcast_bytes), on, how)
    other = _hinted(values.withColumnsRenamed({k: f"_right_{k}" for k in on}), size, broadcast_bytes)
    return rows.join(other, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in on], how).drop(*[f"_right_{k}" for k in on])


def _hinted(values: DataFrame, size: int, broadcast_bytes: int) -> DataFrame:
    return F.broadcast(values) if size <= broadcast_bytes else values.hint("merge")
