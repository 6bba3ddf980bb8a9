"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import saved


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Join each node's neighbours (larger ones if `large`, else smaller) to the least node of its star."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    # saved: the join is then no part of the grouping, and Spark can split a node with very many neighbours
    least = saved(least)
    turned = both.join(least, "a")
    moved = turned.filter("b > a") if large else turned
    moved = moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
    moved = moved if large else moved.unionByName(least.select("a", F.col("m").alias("b")))
    return moved.filter("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node that each node of the edges (a, b) reaches.

    Nodes are whole numbers. Loops and repeated edges are allowed; a null end drops the edge. Each round
    halves the depth of what is left, and is cut off through the checkpoint folder; only a count and a sum
    come to the driver.
    """
    nodes = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b")
    now, mark = saved(nodes.distinct()), None
    while True:
        row = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(row) == mark or not row[0]:
            break
        mark = tuple(row)
        now = saved(_star(_star(now, True), False))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
