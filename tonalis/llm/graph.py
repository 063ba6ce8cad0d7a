"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import release, saved


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``comp`` for the nodes of ``edges`` (``a``, ``b``, longs): ``comp`` is the smallest node reached.

    Every step links each node's neighbours to the smallest of them; the edges
    are written to the shared folder after each.  Nothing is gathered on the
    driver but two sums, which tell that a step changed nothing.  A hub's edges, 16
    bytes each, meet in a sort-merge join, which adaptive execution splits where
    they are many.  Edges with a null end and those of a node to itself are left
    out, repeated ones count once, and an empty table has no components.
    """
    checksum = (F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"))
    now = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")
    before, sums = None, now.agg(*checksum).first()
    while sums != before:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a AND b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        links = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))
        small = large.join(small_least, "a").select(F.explode(links).alias("e")).select("e.*").where("a > b").distinct()
        old, now = now, saved(small, "edges")
        release(old)
        before, sums = sums, now.agg(*checksum).first()
    stars = now.groupBy("a").agg(F.min("b").alias("comp")).withColumnRenamed("a", "node")
    return stars.unionByName(stars.select(F.col("comp").alias("node"), "comp").distinct())
