"""Ranks over a whole table or a large group without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import settled


def _before(counts: DataFrame, group: list[str], count: str) -> DataFrame:
    """For each partition and group how much the partitions before hold of the group: a row for each pair of them."""
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("_part", *group, F.coalesce(F.sum(count).over(earlier), F.lit(0)).alias("_before"))


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` with the other columns of ``right`` where the keys are equal or both null."""
    names = [f"_key{k}" for k in range(len(keys))]
    renamed = right.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], *[c for c in right.columns if c not in keys])
    same = F.lit(True)
    for k, n in zip(keys, names, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(n))
    return left.join(renamed, same, how).drop(*names)


def global_rank(df: DataFrame, group: str | list[str], order: list[Column], out: str = "rank") -> DataFrame:
    """``df`` with its rank within ``group`` by a total order.

    Rows are range-partitioned by group and order; the rank is the place within the partition plus the rows
    that the partitions before hold of the group, so a group of any size is spread over many tasks. The range
    boundaries are drawn once, when the partitions are written to the shared folder.
    """
    group = [group] if isinstance(group, str) else group
    ranged = settled(df.repartitionByRange(*map(F.asc, group), *order).withColumn("_part", F.spark_partition_id()))
    within = ranged.withColumn("_at", F.row_number().over(Window.partitionBy("_part", *group).orderBy(*order)))
    before = _before(ranged.groupBy("_part", *group).count(), group, "count")
    placed = join_same(within, before, ["_part", *group])
    return placed.select(*df.columns, (F.col("_at") + F.col("_before")).cast("long").alias(out))


def tie_ranks(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """For each group and value, in a row each: ``rank``, the mean place of the rows with that value among those of the
    group, and ``of``, the rows of the group that have a value.

    Equal values are counted first, so ties never lie on both sides of a partition's border, and what is sorted has a
    row for each different value. Null values have no rank.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    ranged = settled(counted.repartitionByRange(*map(F.asc, group), F.asc(value)).withColumn("_part", F.spark_partition_id()))
    sums = ranged.groupBy("_part", *group).agg(F.sum("_n").alias("_sum"))
    before = _before(sums, group, "_sum")
    total = sums.groupBy(*group).agg(F.sum("_sum").alias("of"))
    own = Window.partitionBy("_part", *group).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = ranged.withColumn("_up_to", F.sum("_n").over(own))
    mean = F.col("_before") + F.col("_up_to") - (F.col("_n") - 1) / 2.0
    placed = join_same(within, before, ["_part", *group]).select(*group, value, mean.alias("rank"))
    return join_same(placed, total, group)


def percentile(df: DataFrame, value: str, by: list[str], out: str = "pct") -> DataFrame:
    """Average-tie percentile rank of a value within groups; null values have none and do not count."""
    ranks = tie_ranks(df, by, value).select(*by, value, (F.col("rank") / F.col("of")).alias(out))
    return join_same(df, ranks, [*by, value], "left")


def group_sizes(df: DataFrame, group: list[str], out: str) -> DataFrame:
    """``df`` with the number of rows of its group, counted in the tasks that read them before anything moves."""
    return join_same(df, df.groupBy(*group).agg(F.count(F.lit(1)).alias(out)), group)
