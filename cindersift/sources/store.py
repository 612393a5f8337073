"""A store of snapshots: a log in parts by day, to which runs are added and of which the last word counts.

A run is added by its name; names sort by time (an ISO time does). Rows of a later run replace those of an earlier one
with the same ticker and time when the store is read, so a run that is written twice gives each row once, and one that
broke off, whose files were never committed, gives none. Nothing that is there is rewritten to add a run; ``compact``
rewrites single days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import settled

SNAPSHOT = "ticker string, scanned_at string, score double, flags array<string>"
STORED = f"{SNAPSHOT}, run string, day string"


def _day():
    return F.coalesce(F.nullif(F.substring("scanned_at", 1, 10), F.lit("")), F.lit("none"))


def add_run(snapshots: DataFrame, path: str, run: str) -> None:
    """Add ``snapshots(ticker, scanned_at, score, flags)`` as ``run``. Rows without a ticker or a time go."""
    told = snapshots.select("ticker", "scanned_at", "score", "flags").where("ticker IS NOT NULL AND scanned_at IS NOT NULL")
    told.withColumn("run", F.lit(run)).withColumn("day", _day()).write.mode("append").partitionBy("day").parquet(path)


def _last(rows: DataFrame) -> DataFrame:
    """Of rows with one ticker and time that of the last run; of equal ones of a run the largest by score, then flags."""
    best = F.max(F.struct("run", "score", "flags")).alias("m")
    return rows.groupBy("day", "ticker", "scanned_at").agg(best).select("ticker", "scanned_at", "m.score", "m.flags", "m.run", "day")


def read_store(spark: SparkSession, path: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """ticker, scanned_at, score, flags of the store, each ticker and time once; of the days from ``since`` to ``until``,
    whose parts alone are opened."""
    rows = spark.read.schema(STORED).option("basePath", path).parquet(path)
    if since is not None:
        rows = rows.where(F.col("day") >= since)
    if until is not None:
        rows = rows.where(F.col("day") <= until)
    return _last(rows).select("ticker", "scanned_at", "score", "flags")


def compact(spark: SparkSession, path: str, days: list[str]) -> None:
    """Rewrite some days with each row once; other days stay as they are.

    The rewritten rows are written apart first: a day is replaced only by rows that are all there.
    """
    rows = settled(_last(spark.read.schema(STORED).option("basePath", path).parquet(path).where(F.col("day").isin(days))))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
