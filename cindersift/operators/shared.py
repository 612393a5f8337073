"""Relations that several parts of one query read: made once, let go when the query's tables are written."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_held: ContextVar[list[DataFrame] | None] = ContextVar("held", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares: the checkpoint folder that was set, else the setting ``spark.checkpoint.dir``.

    Only in local mode, where driver and executors are one process, may both be unset.
    """
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
    return f"file://{tempfile.gettempdir()}/checkpoints/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read from there; what it was made from is no longer needed."""
    path = new_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scope() -> Iterator[list[DataFrame]]:
    """Within it ``share`` keeps relations; on leaving, also by an error, all of them are released.

    What leaves the scope must be settled before. A lost executor's part of a kept relation is made again from its
    source. Scopes may be nested; each releases its own.
    """
    held: list[DataFrame] = []
    token = _held.set(held)
    try:
        yield held
    finally:
        _held.reset(token)
        for df in reversed(held):
            df.unpersist()


def share(df: DataFrame) -> DataFrame:
    """``df`` kept in memory, or on disk where that is full, until the scope ends; outside of any it is left as it is."""
    held = _held.get()
    if held is not None:
        df.persist(StorageLevel.MEMORY_AND_DISK)
        held.append(df)
    return df
