"""Connected components by alternating large-star and small-star steps, every step a join on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselon.llm.common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, comp) with comp the least node reachable, for every node on an edge ``(a, b)``; loops are ignored."""
    e = scratch.write(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), f"{name}-edges")
    mark = _mark(e)
    while mark[0]:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(down, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x"))
            .select("x.u", "x.v")
            .filter("u <> v")
            .distinct()
        )
        new = scratch.write(small, f"{name}-round")
        scratch.drop(e)
        e, old = new, mark
        mark = _mark(e)
        if mark == old:
            break
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def _mark(e: DataFrame):
    return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
