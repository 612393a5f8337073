"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separator of words throughout the operators.
SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]+"
#: A table of numbers is broadcast up to so many rows, some 100 MB in memory.
MOST_SENT = 2_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it from there.

    The folder is ``shared_folder``. What is written stays there for the session, so that a lost executor can
    read it again; ``spark.cleaner.referenceTracking.cleanCheckpoints`` removes what is no longer referred to.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares, ``spark.checkpoint.dir``.

    Only in local mode, where driver and executors are one process, may it be unset; a cluster without it is
    an error, as a folder of one machine would lose data there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
    return f"{tempfile.gettempdir()}/checkpoints/{spark.sparkContext.applicationId}"


def written(df: DataFrame) -> DataFrame:
    """Like ``settle``, as a compressed table: smaller than a checkpoint, and read back in few tasks if it is small."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _dealt(df: DataFrame, a_core: int) -> DataFrame:
    """``df`` in ``a_core`` partitions a core, unless adaptive execution merges the small partitions of a shuffle itself."""
    spark = df.sparkSession
    if all(spark.conf.get(f"spark.sql.adaptive.{x}", "true") == "true" for x in ("enabled", "coalescePartitions.enabled")):
        return df
    return df.repartition(a_core * spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """The rows of ``df`` for Python, which costs a task more than the few rows that each of many shuffle partitions may have."""
    return _dealt(df, 2)


def listed(df: DataFrame) -> DataFrame:
    """Like ``written``, for tables of ids, which are small beside the texts at any size.

    A file costs a task more than the few rows that each of many shuffle partitions has of such a table.
    """
    return written(_dealt(df, 1))


def with_ids(df: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` whose ``name`` is in the table ``ids``, once or more, which is sent to all tasks if it is small."""
    few = ids.limit(MOST_SENT + 1).count() <= MOST_SENT
    return df.join(F.broadcast(ids) if few else ids, name, "left_semi")


def words(text):
    """Words of a text column: maximal runs of characters that are no ASCII white space; none for null."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, SPACE)).otherwise(F.array().cast("array<string>"))
