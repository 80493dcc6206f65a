"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweave.llm import common


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v; u <> v), the component named by its least node.

    Each round is written to the shared folder; the number of rounds grows with the logarithm of the largest component.
    """
    stars = common.materialize(edges.select("u", "v").distinct(), "edges", narrow=True)
    before = None
    while True:
        last, stars = stars, common.materialize(_small_star(_large_star(stars)), "stars", narrow=True)
        common.discard(last)
        state = stars.agg(F.count("*").alias("n"), F.sum((F.xxhash64("u", "v") % 1_000_000_007).cast("bigint")).alias("h")).first()
        if (state["n"], state["h"]) == before:
            break
        before = state["n"], state["h"]
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(stars.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
