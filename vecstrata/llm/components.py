"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import hot_join, written


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges(a, b): the root is the least node of its component.

    Each round connects every node's larger neighbours, then its smaller ones,
    to the least neighbour; the rounds grow with the logarithm of the
    longest path. Rounds are written to the shared folder. A node with very many
    edges is no trouble: its least neighbour is a partial aggregate, and the join
    on it is split. Self-loops and repeated edges change nothing.
    """
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    mark = _mark(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = hot_join(both, least, "a", 2 * mark[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large, "components")
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = hot_join(large, least, "a", 2 * mark[0])
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m")).where("a <> b").distinct()
        now = written(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
        new = _mark(now)
        if new == mark:
            break
        mark = new
    roots = now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def _mark(edges: DataFrame) -> tuple:
    """Number and hash of the edges; equal for equal sets."""
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]
