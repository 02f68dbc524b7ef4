"""Connected components of an edge list, by rounds of joins that each cut the longest way to the least member."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from threadline.durable import durable, let_go


def _both_ways(edges: DataFrame) -> DataFrame:
    turned = F.struct(F.col("b").alias("a"), F.col("a").alias("b"))
    return edges.select(F.explode(F.array(F.struct("a", "b"), turned)).alias("_e")).select("_e.a", "_e.b")


def components(edges: DataFrame) -> DataFrame:
    """From edges (a, b): every node that has an edge, with root, the least node of its component.

    Large-star and small-star steps (Kiveris et al., 2014) alternate until every node but the roots has one neighbour, its
    root; each step groups by node with a map-side minimum, and a hot node's neighbours are never gathered in one place.
    """
    now = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        between = (F.min("b") < F.col("a")) & (F.count("*") > 1)
        least = durable(_both_ways(now).groupBy("a").agg(F.least("a", F.min("b")).alias("m"), between.alias("between")))
        if least.where("between").isEmpty():
            return least.select(F.col("a").alias("node"), F.col("m").alias("root"))
        # large star: every larger neighbour points to the least of the node and its neighbours
        large = durable(_both_ways(now).join(least.select("a", "m"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        # small star: every smaller neighbour, and the node, point to the least
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        now = durable(small.distinct())
        let_go(edges.sparkSession)


def joined(roots: DataFrame, more: DataFrame) -> DataFrame:
    """The components after more edges (a, b), from those before: roots stand for all edges that made them."""
    if more.isEmpty():
        return roots
    return components(roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).union(more.select("a", "b")))
