"""Connected components and pairs of blocks, for links that are never gathered in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.session import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The smallest node reachable from each node of the links: columns node and component.

    In a round every node moves to its smallest neighbour, or that one's if smaller; links are then
    taken between the places reached, and those within a place fall away. Neighbours are reduced to
    their minimum before they are shuffled; none are gathered, however many a node has. Links and
    rounds are written down, so all rounds see the same links.
    """
    links = materialize(edges.select(F.col(a).alias("node"), F.col(b).alias("other")).where("node <> other").distinct(), "links")
    links = materialize(links.unionByName(links.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "links")
    labels = None
    while True:
        near = materialize(links.groupBy("node").agg(F.min("other").alias("near")).select("node", F.least("node", "near").alias("near")), "near")
        above = near.select(F.col("node").alias("near"), F.col("near").alias("higher"))
        moved = materialize(near.join(above, "near").select("node", F.col("higher").alias("place")), "moved")
        if labels is None:
            labels = moved.withColumnRenamed("place", "label")
        else:
            step = moved.select(F.col("node").alias("label"), "place")
            labels = materialize(labels.join(step, "label", "left").select("node", F.coalesce("place", "label").alias("label")), "labels")
        ends = links.join(moved, "node").select("other", F.col("place").alias("a"))
        there = moved.select(F.col("node").alias("other"), F.col("place").alias("b"))
        links = materialize(ends.join(there, "other").where("a <> b").select(F.col("a").alias("node"), F.col("b").alias("other")).distinct(), "links")
        if links.isEmpty():
            return labels.select("node", F.col("label").alias("component"))


def blocks(size: Column, most: int) -> Column:
    """Number of blocks of at most about ``most`` rows."""
    return F.greatest(F.ceil(size / most), F.lit(1)).cast("int")


def block_pairs(block: Column, count: Column) -> Column:
    """The pairs (first, second) of a group's blocks that hold this block; every two blocks meet in one."""
    return F.transform(F.sequence(F.lit(0), count - 1), lambda t: F.struct(
        F.least(block, t).alias("first"), F.greatest(block, t).alias("second")))
