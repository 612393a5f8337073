"""Connected components by iterative joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import listed


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for each node of ``edges(a, b)``; the label is the smallest node of the component.

    Every node points to a node of its component that is not larger. In each round a node, and the node it
    points to, are hooked to the least grandparent of its neighbours, and paths are halved, until nothing
    changes; the number of rounds grows with the logarithm of the longest path. Hubs are reduced in the tasks
    that read them; what joins with them are written tables, whose large partitions adaptive execution splits.
    Loops and repeated edges have no effect.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = listed(e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("s")).select("s.*"))
    f = listed(e.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("p")))
    while True:
        g = listed(f.join(f.select(F.col("node").alias("p"), F.col("p").alias("gp")), "p").select("node", "p", "gp"))
        near = e.join(g.select(F.col("node").alias("v"), F.col("gp").alias("m")), "v").groupBy("u").agg(F.min("m").alias("m"))
        held = listed(g.join(near.withColumnRenamed("u", "node"), "node"))
        own = F.struct("node", F.least("p", "gp", "m").alias("to"), F.col("p").alias("was"))
        parent = F.struct(F.col("p").alias("node"), F.col("m").alias("to"), F.lit(None).cast(f.schema["p"].dataType).alias("was"))
        told = held.select(F.explode(F.array(own, parent)).alias("s")).select("s.*").groupBy("node").agg(F.min("to").alias("p"), F.max("was").alias("was"))
        now = listed(told)
        f = now.select("node", "p")
        if now.where("p < was").isEmpty():
            return f.select("node", F.col("p").alias("label"))
