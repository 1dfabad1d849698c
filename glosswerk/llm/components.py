"""Connected components of an edge table by alternating large-star and small-star
rounds, each a grouping and a join over the edges that are left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosswerk.llm.shared import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """node, component (its smallest node) for every node of (a long, b long) edges.

    Rounds go on until the edges are stars around their smallest nodes; every
    round's edges are written to the shared folder, so no lineage builds up.
    """
    stars, sign, k = scratch.write(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}0"), None, 0
    while True:
        # Large star: neighbours above a node move to the smallest node around it.
        both = stars.unionAll(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and its smaller neighbours move to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        k += 1
        new = scratch.write(moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct(), f"{name}{k}")
        scratch.drop(f"{name}{k - 1}")
        stars, before = new, sign
        sign = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if sign == before or sign[0] == 0:
            break
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(stars.select("b", "b").distinct())
