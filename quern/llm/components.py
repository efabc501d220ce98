"""Connected components of an edge table, without any group in one task or at the driver.

Alternates two steps: every larger neighbour of a node moves to the node's smallest neighbour, then every smaller
neighbour does. Edges never grow in number, and the tables become stars in a number of rounds that grows with the
logarithm of the longest path. The driver sees a count and a sum of each round, no edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import ROWS_A_FILE, stable


def _to_smallest(edges: DataFrame) -> DataFrame:
    """Large step: for each node, its larger neighbours are tied to the smallest of it and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = edges.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u")
    return moved.select(F.col("w").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _to_parent(edges: DataFrame) -> DataFrame:
    """Small step: each node's smaller neighbours and the node itself are tied to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def components(edges: DataFrame, rounds: int = 60, most: int | None = None) -> DataFrame:
    """From edges (a, b) of comparable ids to (node, root): each node that has an edge, and the least of its component.

    ``most`` bounds the edges, if that is known: it sizes the files, not the result.
    Self-edges, repeated edges and edges with a null are ignored; no edges give no rows.
    """
    now = edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, before = stable(now, most), None
    n = now.count() if most is None or most > ROWS_A_FILE else most
    for _ in range(rounds):
        now = stable(_to_parent(_to_smallest(now)), 2 * n)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == before:
            break
        before, n = seen, seen[0]
    else:
        raise RuntimeError(f"no stars after {rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
