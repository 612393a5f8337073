"""The nearest row in time, by one sort.

Points and the times asked for are one relation, sorted by key and time; the last point before a time and the first
after it are carried along in windows. Work is that of a sort, however many points a key has; a join on the key with
the range as a further test would meet all of a key's points with all of its times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest(asked: DataFrame, points: DataFrame, keys: list[str], at: Column, point_at: Column, before: int, after: int, prefer: list[Column], carry: list[str]) -> DataFrame:
    """Rows of ``asked`` with ``carry`` of the nearest point of equal ``keys``, and ``delta``, its days from ``at``.

    ``at`` and ``point_at`` are dates, by columns of ``asked`` and of ``points``. A point may lie ``before`` days
    before to ``after`` days after. Of points on one day the least by ``prefer`` stands for the day; of two days
    equally near the one whose point is less by ``prefer`` counts, then the earlier. Rows of ``asked`` without
    such a point, without a time or with a null key have nulls. Every row of ``asked`` comes back once.
    """
    day = F.datediff(point_at, F.lit("1970-01-01").cast("date"))
    kept = points.select(*keys, day.alias("_day"), F.struct(*[c.alias(f"_p{k}") for k, c in enumerate(prefer)], *carry).alias("_point")).where("_day IS NOT NULL").dropna(subset=keys)
    days = kept.groupBy(*keys, "_day").agg(F.min("_point").alias("_point"))
    row = F.struct(*[c for c in asked.columns if c not in keys])
    times = asked.select(*keys, F.datediff(at, F.lit("1970-01-01").cast("date")).alias("_day"), F.lit(None).cast(days.schema["_point"].dataType).alias("_point"), row.alias("_row"))
    both = times.unionByName(days.withColumn("_row", F.lit(None).cast(times.schema["_row"].dataType)))
    found = F.when(F.col("_point").isNotNull(), F.struct("_day", "_point"))
    onward, back = Window.partitionBy(*keys).orderBy(F.col("_day").asc()), Window.partitionBy(*keys).orderBy(F.col("_day").desc())
    up_to = lambda w: F.last(found, ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    met = both.withColumn("_last", up_to(onward)).withColumn("_next", up_to(back)).where("_row IS NOT NULL")
    near = lambda c, low, high: F.when((F.col(f"{c}._day") - F.col("_day")).between(low, high), F.struct(F.abs(F.col(f"{c}._day") - F.col("_day")).alias("far"), F.col(f"{c}._point").alias("point"), (F.col(f"{c}._day") - F.col("_day")).alias("delta")))
    one, two = near("_last", -before, after), near("_next", -before, after)
    rank = lambda c: F.struct(c["far"], *[c["point"][f"_p{k}"] for k in range(len(prefer))], c["delta"])
    best = F.when(one.isNull(), two).when(two.isNull() | (rank(one) <= rank(two)), one).otherwise(two)
    out = met.withColumn("_best", best)
    return out.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in asked.columns], *[F.col(f"_best.point.{c}").alias(c) for c in carry], F.col("_best.delta").alias("delta"))
