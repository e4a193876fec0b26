"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinegrade.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours go to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("at"), F.least("m", "u").alias("m"))
    return both.where("v > u").join(least, F.col("u") == F.col("at")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours go to the smallest of them; edges run from u down to v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("at"), "m")
    joined = edges.join(least, F.col("u") == F.col("at"))
    moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select(F.col("at").alias("u"), F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of an edge table (u, v): root is the smallest node of its component.

    Runs until every node points to a root and no root points on, however many rounds that takes:
    the logarithm of a component's size, in practice. A node's edges are never gathered; hubs meet
    as partial minima, and in joins that AQE may split.
    """
    stars = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        stars = written(_small_star(_large_star(stars)), "stars")
        several = stars.groupBy("u").count().where("count > 1").limit(1)
        chained = stars.join(stars.select(F.col("u").alias("next")), F.col("v") == F.col("next"), "left_semi").limit(1)
        if several.isEmpty() and chained.isEmpty():
            break
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
