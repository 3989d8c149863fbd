"""Connected components of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch


def _large_star(edges: DataFrame, disk: Scratch) -> tuple[DataFrame, DataFrame]:
    """Every larger neighbour of a node points to the least of the node and its neighbours."""
    both = edges.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
    least = disk.keep(both.groupBy("a").agg(F.min("b").alias("m")))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")), least


def _small_star(down: DataFrame, disk: Scratch) -> tuple[DataFrame, DataFrame]:
    """From links that lead down: a node and its smaller neighbours point to the least of them."""
    least = disk.keep(down.groupBy("a").agg(F.min("b").alias("m")))
    moved = down.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))), least


def components(links: DataFrame, disk: Scratch) -> DataFrame:
    """``node, component`` for every node of the links ``a, b``; a component's name is its least node.

    A node's least neighbour is found by an aggregate that combines before the
    shuffle and is written, so the links of a node that a third of them meet
    are the large side of a plain join, which Spark splits.  Each step is
    written to the shared folder, so an executor that is lost costs one step;
    the driver sees one fingerprint of the links per step.
    """
    edges, before = links.filter("a != b"), None
    while True:
        large, least = _large_star(edges, disk)
        down = disk.keep(large)
        disk.drop(least)
        small, least = _small_star(down, disk)
        after = disk.keep(small.distinct())
        disk.drop(least)
        disk.drop(down)
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before is not None:
            disk.drop(edges)
        edges = after
        if mark == before:
            break
        before = mark
    tops = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(tops.select("node", F.col("node").alias("component")))
