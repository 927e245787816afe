"""Distributed connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _with_minimum(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the least neighbour of u; a hot u is one row on the right, so a skewed join can be split."""
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    return edges.join(least, "u")


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """Rows (node, component): every node of an edge with the least node that it is connected to.

    edges: columns u, v of one orderable type; direction, repeats and loops do not matter, rows with a
    null are ignored. Alternates large-star and small-star steps, which keep connectivity while all
    edges come to point at component minima; each step writes a table, so no lineage builds up. The
    number of edges never grows, whatever the degree of a node.
    """
    clean = edges.select("u", "v").filter("u <> v")
    now = scratch.store(clean.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            _with_minimum(both)
            .withColumn("least", F.least("least", "u"))
            .filter("v > u")
            .select(F.col("v").alias("u"), F.col("least").alias("v"))
        )
        small = _with_minimum(large.distinct())
        pairs = small.select("v", "least").filter("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
        own = small.select("u", F.col("least").alias("v"))
        following = scratch.store(pairs.unionByName(own).distinct(), "edges", F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("total"))
        state = following.seen
        scratch.drop(now)
        now = following
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
