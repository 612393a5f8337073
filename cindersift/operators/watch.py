"""Watchlists and change tracking between runs.

``snapshots``: ticker, scanned_at, score, flags (array). Of rows with one ticker and time the last written counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import ALERT_DROP, GATE_REASONS, MATERIAL_FLAGS


def append(snapshots: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new snapshots, where a new one replaces an old one of the same ticker and time; of equal new ones
    the largest by score, then flags, counts."""
    rest = [c for c in new.columns if c not in ("ticker", "scanned_at")]
    first = sorted(rest, key=lambda c: (c != "score", c))
    new = new.groupBy("ticker", "scanned_at").agg(F.max(F.struct(*first)).alias("m")).select(*[F.col(f"m.{c}").alias(c) if c in rest else F.col(c) for c in new.columns])
    return snapshots.join(new.select("ticker", "scanned_at"), ["ticker", "scanned_at"], "left_anti").select(*new.columns).unionByName(new)


def diff(snapshots: DataFrame) -> DataFrame:
    """Each snapshot against the one before: prior and new score, delta, new and cleared flags, alerts. A first one is a baseline."""
    order = Window.partitionBy("ticker").orderBy("scanned_at")
    s = snapshots.withColumn("prior", F.lag(F.struct("score", "flags")).over(order))
    without = lambda a, b: F.filter(a, lambda x: ~F.array_contains(b, x))
    has = F.col("prior").isNotNull()
    delta = F.col("score") - F.col("prior.score")
    new = F.when(has, without(F.col("flags"), F.col("prior.flags"))).otherwise(F.array().cast("array<string>"))
    gone = F.when(has, without(F.col("prior.flags"), F.col("flags"))).otherwise(F.array().cast("array<string>"))
    s = s.select("ticker", "scanned_at", "score", delta.alias("delta"), new.alias("new_flags"), gone.alias("cleared_flags"), has.alias("has_prior"))
    return s.withColumn("alerts", alerts(F.col("new_flags"), F.col("delta")))


def alerts(new_flags: Column, delta: Column) -> Column:
    told = F.transform(F.filter(new_flags, lambda f: f.isin(MATERIAL_FLAGS + GATE_REASONS)), lambda f: F.concat(F.lit("new flag "), f))
    fall = F.concat(F.lit("score "), F.format_string("%+.0f", delta))
    return F.concat(told, F.when(F.coalesce(delta <= -ALERT_DROP, F.lit(False)), F.array(fall)).otherwise(F.array().cast("array<string>")))


def latest(snapshots: DataFrame, n: int = 2) -> DataFrame:
    return snapshots.withColumn("nth", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("scanned_at")))).where(F.col("nth") <= n)


def watched(scores: DataFrame, watchlist: DataFrame) -> DataFrame:
    return scores.join(watchlist, "ticker", "left_semi")


def snapshot_flags(modules: Column, reasons: Column, features: Column) -> Column:
    """Modules in order, then gate reasons as given, then features in order; the first of equal ones stays."""
    return F.array_distinct(F.concat(F.array_sort(modules), reasons, F.array_sort(F.array_distinct(features))))


def add(watchlist: DataFrame, tickers: DataFrame, now: Column) -> DataFrame:
    """The watchlist with more tickers (upper-cased); those on it keep their date."""
    new = tickers.select(F.upper(F.trim("ticker")).alias("ticker")).where("ticker <> ''").distinct().withColumn("added_at", now)
    return watchlist.unionByName(new.join(watchlist, "ticker", "left_anti"))


def listing(watchlist: DataFrame) -> DataFrame:
    """The watchlist in the order of adding, then of tickers."""
    return watchlist.orderBy("added_at", "ticker")


def remove(watchlist: DataFrame, tickers: DataFrame) -> DataFrame:
    return watchlist.join(tickers.select(F.upper(F.trim("ticker")).alias("ticker")), "ticker", "left_anti")
