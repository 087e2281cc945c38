"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def _least(edges: DataFrame) -> DataFrame:
    """``(u, m)``: the least of u and its neighbours; partial minima are taken before the shuffle."""
    return edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """``links(u, v)`` of longs -> ``(u, component)`` for every linked vertex, component the least vertex.

    Every round rewrites the links to point at smaller vertices, so a path of n
    links takes about log(n) rounds; only a count reaches the driver.
    """
    edges = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while True:
        # large star: every larger neighbour points at the least neighbour
        both = _both(edges)
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the smaller neighbours and the vertex itself point at the least one
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        after = written(small, "links")
        # done when the links are stars: no vertex has two targets or is both a target and a source
        stars = after.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() == 0 and \
            after.select(F.col("v").alias("u")).distinct().join(after.select("u"), "u", "left_semi").limit(1).count() == 0
        edges = after
        if stars:
            roots = edges.select(F.col("v").alias("u"), F.col("v").alias("component")).distinct()
            return edges.select("u", F.col("v").alias("component")).unionByName(roots)
