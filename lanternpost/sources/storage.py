"""Folders every executor can reach, and intermediate tables kept in them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[str] = []


def side_session(spark: SparkSession) -> SparkSession:
    """A session with the same settings, for writes that are observed.

    A session that has observed a write cannot be serialized any more, and models that Spark fits
    hold on to theirs; so the caller's session is left as it is.
    """
    side = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            side.conf.set(key, value)
    return side


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder under the session's checkpoint directory.

    Only a local session without one (a test) gets a temporary directory; on a cluster the
    executors could not see it.
    """
    base = spark.conf.get(SETTING, None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {SETTING} to a folder that all executors reach")
        base = tempfile.mkdtemp(prefix="run-")
    path = f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"
    _written.append(path)
    return path


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Writes made inside delete their shuffle files as they end, not when the driver next collects its garbage."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The table written once and read back.

    For results that several branches of a plan use: they are computed once, and a lost
    executor costs a read instead of the whole lineage.
    """
    path = shared_folder(df.sparkSession, purpose)
    with shuffles_deleted(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_kept(path: str) -> bool:
    """Whether a folder of this session has not been released."""
    return path in _written


def discard(table: DataFrame) -> None:
    """Delete the files of a stored table that no later plan reads."""
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        delete(table.sparkSession, folder)


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables written so far; call it when their results have been read."""
    while _written:
        delete(spark, _written.pop())


def delete(spark: SparkSession, folder: str) -> None:
    """Remove a folder and what is in it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
