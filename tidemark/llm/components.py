"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (u, v); component is its smallest reachable node.

    Each step joins edges to one minimum per node, so no neighbourhood is ever held in one place; a hot node's edges
    are a skewed join side, which adaptive execution splits. Loops and repeated edges are allowed; no edges: no rows.
    """

    def mins(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))

    now = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    n = now.count()
    while n:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(mins(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large.where("u <> v"), "edges")
        small = large.join(mins(large), "u")
        small = small.select("u", F.col("m").alias("v")).union(small.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        before, n_before, now = now, n, materialise(small, "edges")
        n = now.count()
        # both hold distinct edges, so they are the same if they are as many and none is new
        still = n == n_before and now.join(before, ["u", "v"], "left_anti").isEmpty()
        discard(before)
        discard(large)
        if still:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v")).distinct())
