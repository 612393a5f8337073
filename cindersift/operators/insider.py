"""Insider conviction from ownership transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import CONFIDENCE
from ..functions.expr import recent

EXCLUDED = ["A", "M", "F", "G", "C", "J", "D"]
LARGE = 500_000.0


def profile(transactions: DataFrame, notices: DataFrame | None = None, times: str | None = None) -> DataFrame:
    """One row per company: buyers, values bought and sold by kind, signal, confidence, conviction.

    ``transactions``: cik, insider, code, value, is_10b5_1, preceded_by_exercise. ``notices``: cik and n_144.
    A sale under a plan is that first, whatever else it is. A row stands for as many transactions as its column
    ``times`` says, if that is named, and its value for all of theirs.
    """
    each = F.col(times) if times else F.lit(1)
    n = lambda test: F.coalesce(F.sum(F.when(test, each)), F.lit(0)).cast("long")
    plan, linked = F.coalesce("is_10b5_1", F.lit(False)), F.coalesce("preceded_by_exercise", F.lit(False))
    sold = F.col("code") == "S"
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("value"))), F.lit(0.0))
    out = transactions.groupBy("cik").agg(
        F.count_distinct(F.when(F.col("code") == "P", F.col("insider"))).alias("buyers"), n(F.col("code") == "P").alias("n_buys"), total(F.col("code") == "P").alias("bought"),
        total(sold & ~plan & ~linked).alias("sold_freely"), n(sold & ~plan & ~linked).alias("n_free"), total(sold & plan).alias("sold_by_plan"), total(sold & linked & ~plan).alias("sold_after_exercise"),
        n(F.col("code").isin(EXCLUDED)).alias("n_excluded"),
    )
    out = out.join(notices, "cik", "full") if notices is not None else out.withColumn("n_144", F.lit(0).cast("long"))
    out = out.na.fill(0)
    cluster, over = F.col("buyers") >= 2, F.col("n_144") >= 2
    net = F.when(cluster & (F.col("bought") > F.col("sold_freely")), "bullish").when((F.col("sold_freely") > 0) | over, "bearish").otherwise("neutral")
    sure = F.when((F.col("buyers") >= 3) | (F.col("bought") >= LARGE), "high").when(cluster | (F.col("n_free") > 0) | over, "medium").otherwise("low")
    return out.withColumn("cluster", cluster).withColumn("overhang", over).withColumn("net", net).withColumn("confidence", sure).withColumn("conviction", F.least(F.lit(100), F.col("buyers") * 20 + F.when(F.col("bought") >= LARGE, 20).otherwise(0)).cast("long"))


def sub_score(net: Column, cluster: Column, confidence: Column) -> Column:
    base = F.when(net == "bullish", 1.0).when(net == "bearish", 0.0).when(net.isNotNull(), 0.3)
    floor = F.when(cluster, F.greatest(base, F.lit(0.8))).otherwise(base)
    scale = F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv])
    return F.round(floor * F.coalesce(F.try_element_at(scale, confidence), F.lit(0.5)), 4)


def ownership(filings: DataFrame) -> DataFrame:
    """Counts of 13D, 13G and crossings, and filers that went from 13G to 13D: cik, n_13d, n_13g, n_over_5, n_converted.

    ``filings``: cik, filer, form_type, date, pos, pct. A form that names both counts as 13G in the order of events.
    """
    name = F.upper("form_type")
    g, d = name.contains("13G"), name.contains("13D")
    before = Window.partitionBy("cik", "filer").orderBy("date", "pos").rowsBetween(Window.unboundedPreceding, -1)
    marked = filings.withColumn("g", g).withColumn("d", d).withColumn("turned", d & ~g & F.coalesce(F.max(g.cast("int")).over(before) == 1, F.lit(False)))
    by_filer = marked.groupBy("cik", "filer").agg(F.count_if("d").alias("n_13d"), F.count_if("g").alias("n_13g"), F.count_if(F.col("pct") > 5.0).alias("n_over_5"), F.bool_or("turned").alias("turned"))
    return by_filer.groupBy("cik").agg(F.sum("n_13d").alias("n_13d"), F.sum("n_13g").alias("n_13g"), F.sum("n_over_5").alias("n_over_5"), F.count_if("turned").alias("n_converted"))


def accumulation(positions: DataFrame) -> DataFrame:
    return positions.groupBy("cik").agg(F.count_if(F.col("change_shares") > 0).alias("accumulating"))


def recent_forms(filings: DataFrame, as_of: Column, most: int = 12, days: int = 365) -> DataFrame:
    """The newest ownership forms of each company within a year, at most ``most``, and whether the limit was hit."""
    kept = filings.where(F.trim("form").isin("4", "4/A", "5", "5/A") & recent(as_of, F.col("filing_date"), days))
    ranked = kept.withColumn("nth", F.row_number().over(Window.partitionBy("cik").orderBy("pos"))).where(F.col("nth") <= most)
    return ranked.withColumn("cap_hit", F.max("nth").over(Window.partitionBy("cik")) == most)
