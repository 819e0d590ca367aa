"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.storage import stored
from .common import join_counted


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of all nodes in ``edges`` (columns ``a, b``); the smallest node names it.

    Every node keeps its edge to its smallest neighbour and hands its other edges on to that
    neighbour, until one edge is left to each; then parents are followed to the roots.  Each
    round is written to the shared folder.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    rows = stored(edges.where("a <> b").select(high.alias("m"), low.alias("c")).distinct(), "edges")
    if rows.isEmpty():
        return rows.select(F.col("m").alias("node"), F.col("c").alias("component"))
    while True:
        best = stored(rows.groupBy("m").agg(F.min("c").alias("p"), F.count(F.lit(1)).alias("n")), "parents")
        several = best.where("n > 1")
        if several.isEmpty():
            break
        others = join_counted(rows, several, ["m"]).where("c <> p").select(F.col("c").alias("m"), F.col("p").alias("c"))
        rows = stored(best.select("m", F.col("p").alias("c")).unionByName(others).distinct(), "edges")
    tree = best.select("m", "p")
    while True:
        counts = tree.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
        above = stored(counts.join(tree.select(F.col("m").alias("p"), F.col("p").alias("g")), "p"), "above")
        if above.isEmpty():
            break
        tree = stored(join_counted(tree, above, ["p"], how="left").select("m", F.coalesce("g", "p").alias("p")), "tree")
    roots = tree.select(F.col("p").alias("node")).distinct()
    return tree.select(F.col("m").alias("node"), F.col("p").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
