"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders that enclose what is written now, the innermost last.
_WITHIN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where the session has none, a temporary folder, but only if all tasks run in the
    driver's own process: executors of a cluster would each write to their own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="undertow-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def session_dir(spark: SparkSession) -> str:
    """This session's own part of the shared folder; it goes when the session's process ends."""
    found = f"{shared_dir(spark)}/undertow/{spark.sparkContext.applicationId}"
    _file_system(spark, found)[0].deleteOnExit(_file_system(spark, found)[1])
    return found


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{_WITHIN[-1] if _WITHIN else session_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def folder(spark: SparkSession, name: str) -> Iterator[str]:
    """Everything that is staged meanwhile lies in this new folder, so that it can be removed together."""
    path = stage_path(spark, name)
    _WITHIN.append(path)
    try:
        yield path
    finally:
        _WITHIN.remove(path)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df there and read it again: the lineage is cut, and values that depend on the partitioning stay."""
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a shuffle that one task of a session for_rows takes, and partitions up to which such a session plans but once.
TASK_ROWS, PLAIN = 100_000, 4


def for_rows(spark: SparkSession, rows: int) -> SparkSession:
    """A session of the same application for rounds over tables of about so many rows: with no more shuffle partitions than these
    need, and without re-planning where there are so few that nothing can be skewed. It changes how fast rounds start, not what
    they give."""
    parts = max(1, -(-rows // TASK_ROWS))
    if parts >= int(spark.conf.get("spark.sql.shuffle.partitions")):
        return spark
    own = spark.newSession()
    if not own.conf.get("spark.checkpoint.dir", None):
        own.conf.set("spark.checkpoint.dir", shared_dir(spark))
    own.conf.set("spark.sql.shuffle.partitions", str(parts))
    own.conf.set("spark.sql.adaptive.enabled", str(parts > PLAIN).lower())
    return own


def staged_in(session: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Like staged, but read by another session of the same application."""
    path = stage_path(session, name)
    df.write.parquet(path)
    return session.read.schema(df.schema).parquet(path)


def for_rounds(df: DataFrame, name: str, rows_each: int = 1) -> DataFrame:
    """df, written, and read by a session for_rows of so many times its rows."""
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    read = lambda session: session.read.schema(df.schema).parquet(path)
    return read(for_rows(df.sparkSession, rows_each * read(df.sparkSession).count()))


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate tables; results that depend on it can't be read afterwards."""
    system, where = _file_system(spark, path)
    system.delete(where, True)


def clear_stages(spark: SparkSession) -> None:
    """Delete this session's intermediate tables; results that were not written elsewhere can't be read afterwards."""
    remove(spark, session_dir(spark))
