"""Connected components of links, on DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.session import stored


def components(links: DataFrame, name: str, rounds: int = 100) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) for every node in ``links`` (``a``, ``b``).

    Large-star and small-star steps alternate until every node points at one root only. Each step takes a
    minimum per node, combined before the shuffle and stored, and joins it back, so that a node with
    very many links is an ordinary skewed join, which adaptive execution splits, and never a group in
    one task. Each round is stored, which cuts the lineage. Links with a null end and from a node to itself are left out.
    """
    edges = stored(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .filter("a <> b AND a IS NOT NULL AND b IS NOT NULL")
        .distinct(),
        f"{name}-links",
    )
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        least = stored(least, f"{name}-large")
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.filter("a <> b").distinct(), f"{name}-moved")
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")), f"{name}-small")
        moved = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), f"{name}-round")
        forked = edges.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high")).filter("low < high")
        roots = edges.select(F.col("b").alias("a")).distinct()
        if forked.isEmpty() and edges.join(roots, "a", "left_semi").isEmpty():
            break  # every node points at one root, and nobody's root points on
    else:
        raise RuntimeError(f"components of {name} are not settled after {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
