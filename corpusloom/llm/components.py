"""Connected components by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusloom.session import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes in ``links`` (a, b): the least node reachable.

    Alternates two steps until every node hangs below its component's least node: a node's
    larger neighbours move to its least neighbour, then its smaller ones do. The number of
    rounds grows with the logarithm of the longest path. Every step aggregates to a minimum per
    node before it joins, so a node with millions of links is never collected. Each round is a
    stored table.
    """
    edges = materialize(
        links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(), "edges")
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
        # Large step: every larger neighbour of a node moves to the node's least neighbour.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"),
                                                             F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        # Small step: a node and its smaller neighbours move to the least of these.
        large = materialize(large, "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v != m").select(
            F.col("v").alias("u"), F.col("m").alias("v")).union(
                low.select("u", F.col("m").alias("v")))
        edges = materialize(small.distinct(), "edges")
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(
        edges.select("v", "v").distinct())
