"""Complete-linkage groups from the close pairs alone, without a distance matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinegrade.fixed_values import VECTOR_DISTANCE
from cinegrade.operators.pivot_tree import packed_units
from cinegrade.operators.vectors import close_pairs
from cinegrade.session import scratch_path
from cinegrade.sources.writers import save


def complete_merges(edges: DataFrame) -> DataFrame:
    """(key, group) of the keys of edges (a, b, distance) that hold all pairs within the limit.

    The distance of two groups is that of their farthest members. Each round, every group chooses its nearest
    one, and groups that choose each other merge; for complete linkage this makes the same groups as
    merging the nearest two of all, one after the other. A pair that is not among the edges is beyond
    the limit and forbids a merge, so groups stay inside connected components. Equal distances go
    by the smaller keys, so some two groups choose each other in every round.
    """
    spark = edges.sparkSession
    keep = lambda df, name: save(df, scratch_path(spark, name))
    edges = keep(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance").where("a <> b").groupBy("a", "b").agg(F.max("distance").alias("distance")), "edges")
    groups = keep(edges.select(F.col("a").alias("key")).union(edges.select("b")).distinct().select("key", F.col("key").alias("group")), "groups")
    while not edges.isEmpty():
        rank = F.struct("distance", "a", "b")
        ends = edges.select(F.col("a").alias("at"), rank.alias("edge")).union(edges.select("b", rank))
        chosen = ends.groupBy("at").agg(F.min("edge").alias("edge"))
        merged = chosen.groupBy("edge").count().where("count = 2").select(F.col("edge.a").alias("into"), F.col("edge.b").alias("gone"))
        merged = keep(merged, "merged")  # the greater of two groups takes the name of the smaller
        name = lambda df, c: df.join(merged.withColumnRenamed("gone", c).withColumnRenamed("into", f"{c}_into"), c, "left")
        parts = merged.select("into", F.lit(2).alias("parts"))
        groups = keep(name(groups, "group").select("key", F.coalesce("group_into", "group").alias("group")), "groups")
        moved = name(name(edges, "a"), "b").select(F.coalesce("a_into", "a").alias("x"), F.coalesce("b_into", "b").alias("y"), "distance").where("x <> y")
        moved = moved.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max("distance").alias("distance"), F.count("*").alias("met"))
        size = lambda df, c: df.join(parts.select(F.col("into").alias(c), F.col("parts").alias(f"{c}_parts")), c, "left")
        whole = F.coalesce("a_parts", F.lit(1)) * F.coalesce("b_parts", F.lit(1))
        edges = keep(size(size(moved, "a"), "b").where(F.col("met") == whole).select("a", "b", "distance"), "edges")
    return groups


def complete_groups(vectors: DataFrame, key: str, vec: str, max_distance: float = VECTOR_DISTANCE) -> DataFrame:
    """(key, group): complete linkage cut at a cosine distance; a group goes by its smallest key.

    Equal vectors are at distance 0 and merge before all else: they enter as one. Vectors without a direction are alone.
    """
    spark = vectors.sparkSession
    units = save(packed_units(vectors, key, vec), scratch_path(spark, "units"))
    firsts = save(units.groupBy("u").agg(F.min("key").alias("first")), scratch_path(spark, "firsts"))
    single = vectors.join(firsts.select(F.col("first").alias(key)), key, "left_semi")
    groups = complete_merges(close_pairs(single, key, vec, max_distance)).select(F.col("key").alias("first"), "group")
    named = units.join(firsts, "u").join(groups, "first", "left").select(F.col("key").alias(key), F.coalesce("group", "first").alias("group"))
    return vectors.select(key).join(named, key, "left").select(key, F.coalesce("group", F.col(key)).alias("group"))
