"""Connected components by alternating stars, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, free


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is hung on the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
    return both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are hung on the smallest of these."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.filter("a <> b").unionByName(least.select("a", F.col("least").alias("b")))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) of all nodes of the edges; component: the smallest node of it.

    The edges are rewritten until they are stars, in a number of rounds that grows with the logarithm of the
    longest chain. A hub's smallest neighbour comes from a partial aggregate, and the join that carries it back
    can be split by the adaptive planner, so no task gets a whole component. Each round is cut off in the shared
    folder, and its shuffle files go before the next one. Nulls and loops are no edges; repeated edges count once; no edges give no rows.
    """
    a, b = F.greatest(src, dst), F.least(src, dst)
    now = checkpoint(edges.filter(F.col(src) != F.col(dst)).select(a.alias("a"), b.alias("b")).distinct())
    mark = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    last = mark(now)
    while last[0]:
        now = checkpoint(_small_star(_large_star(now).distinct()).distinct())
        if (found := mark(now)) == last:
            break
        last = found
        free(edges.sparkSession)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def with_links(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components found(node, component) when links(src, dst) are added. Only components that links touch are
    joined, as a graph of their labels, so the work follows the links and not what is in the components already."""
    a = found.select(F.col("node").alias("src"), F.col("component").alias("a"))
    b = found.select(F.col("node").alias("dst"), F.col("component").alias("b"))
    between = links.join(a, "src", "left").join(b, "dst", "left").select(F.coalesce("a", "src").alias("src"), F.coalesce("b", "dst").alias("dst"))
    over = connected_components(between)
    moved = found.join(over.select(F.col("node").alias("component"), F.col("component").alias("least")), "component", "left")
    alone = over.join(found.select("node"), "node", "left_anti")
    return checkpoint(moved.select("node", F.coalesce("least", "component").alias("component")).unionByName(alone))
