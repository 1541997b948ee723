"""Connected components over an edge table: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import cut, forget


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node of `edges`, root being the smallest node of its component.

    Every round is two equality joins on plain exchanges, so AQE can split a hub's rows, and ends in a
    written table, so a lost executor costs one round. Self links, nulls and repeated edges are ignored.
    """
    e = edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo < hi").distinct()
    e = cut(e, "edges")
    before = None
    while True:
        both = e.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(e.select("hi", "lo"))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.join(least, "u").where("v > u").select("v", "m").distinct()
        large = cut(large, "large")
        down = cut(large.groupBy("v").agg(F.min("m").alias("m2")), "down")
        small = (
            large.join(down, "v").where("m != m2").select(F.col("m2").alias("lo"), F.col("m").alias("hi"))
            .union(down.select(F.col("m2"), F.col("v")))
            .distinct()
        )
        small = cut(small, "edges")
        for t in (e, least, large, down):
            forget(t)
        e = small
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(e.select(F.col("lo"), F.col("lo")).distinct())
