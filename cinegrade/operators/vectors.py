"""Close pairs of word vectors, groups of close vectors, and planar projection."""

from __future__ import annotations

import math

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinegrade.fixed_values import VECTOR_DISTANCE
from cinegrade.operators import pivot_tree
from cinegrade.session import cut_lineage, scratch_path
from cinegrade.sources.writers import save


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(vec: Column) -> Column:
    """The vector scaled to length one; null for a zero vector."""
    vec = vec.cast("array<double>")

    def scaled(v: Column) -> Column:
        norm = F.sqrt(dot(v, v))
        return F.flatten(
            F.transform(
                F.array(norm), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n))
            )
        )

    return F.flatten(F.transform(F.array(vec), scaled))


def close_pairs(vectors: DataFrame, key: str, vec: str, max_distance: float = VECTOR_DISTANCE, leaf: int = pivot_tree.LEAF) -> DataFrame:
    """All pairs a < b with cosine distance <= max_distance, exact."""
    leaves = pivot_tree.tree(pivot_tree.packed_units(vectors, key, vec), pivot_tree.theta_of(max_distance), leaf)
    return pivot_tree.in_blocks(leaves, pivot_tree.pairs_within(max_distance), ["a", "b", "distance"])


def close_links(vectors: DataFrame, key: str, vec: str, max_distance: float = VECTOR_DISTANCE, leaf: int = pivot_tree.LEAF) -> DataFrame:
    """Edges (a, b) that connect what all close pairs connect, without listing those pairs.

    Equal vectors become one: a copy links to the smallest key. A block of vectors gives one link for each
    at most, so a dense cluster gives stars and not all of its pairs.
    """
    units = save(pivot_tree.packed_units(vectors, key, vec), scratch_path(vectors.sparkSession, "units"))
    firsts = save(units.groupBy("u").agg(F.min("key").alias("key")), scratch_path(vectors.sparkSession, "firsts"))
    copies = units.join(firsts.withColumnRenamed("key", "first"), "u").where(F.col("key") > F.col("first"))
    leaves = pivot_tree.tree(firsts.select("key", "u"), pivot_tree.theta_of(max_distance), leaf)
    links = pivot_tree.in_blocks(leaves, pivot_tree.links_within(max_distance), ["a", "b"]).where("a <> b")
    return copies.select(F.col("key").alias("a"), F.col("first").alias("b")).unionByName(links)


def probable_pairs(
    vectors: DataFrame, key: str, vec: str, max_distance: float = VECTOR_DISTANCE, bits: int = 12, bands: int = 20, seed: int = 1
) -> DataFrame:
    """Pairs a < b within max_distance that share a band of hyperplane signs: distances exact, recall expected_recall().

    For vectors without structure in many dimensions, where no exact index can exclude anything and close_pairs
    compares all. A band's hot bucket is compared in blocks, like a leaf.
    """
    units = save(pivot_tree.packed_units(vectors, key, vec), scratch_path(vectors.sparkSession, "units"))
    signed = units.mapInArrow(lambda b: pivot_tree.signed_bands(b, bits, bands, seed), f"{pivot_tree.rows_schema(units)}, node bigint, home boolean")
    pairs = pivot_tree.in_blocks(signed, pivot_tree.pairs_within(max_distance), ["a", "b", "distance"])
    return pairs.groupBy("a", "b").agg(F.min("distance").alias("distance"))


def expected_recall(distance: float, bits: int = 12, bands: int = 20) -> float:
    """Share of pairs at a cosine distance that probable_pairs finds; closer ones are found more often."""
    agree = 1 - math.acos(1 - distance) / math.pi
    return 1 - (1 - agree**bits) ** bands


def connected_groups(keys: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(key, group): the smallest key of the connected component each key belongs to.

    Alternates the large-star and small-star steps of Kiveris et al., "Connected
    Components in MapReduce and Beyond" (2014), until no edge changes. Minima combine on
    the map side, so a node with very many neighbours costs no single task. Each round is
    written to the shared checkpoint folder, which keeps lineage short and survives the
    loss of executors.
    """
    current = cut_lineage(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("u <> v")
        .distinct()
    )
    settled = False
    while not settled:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = (
            both.join(least, "u")
            .where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        small = cut_lineage(small)
        # edges are distinct, so equal numbers and no new edge make equal sets
        settled = small.count() == current.count() and small.join(current, ["u", "v"], "left_anti").isEmpty()
        current = small
    roots = current.select(F.col("u").alias(key), F.col("v").alias("group"))
    return keys.select(key).join(roots, key, "left").select(
        key, F.coalesce("group", F.col(key)).alias("group")
    )


def vector_groups(
    vectors: DataFrame, key: str, vec: str, max_distance: float = VECTOR_DISTANCE
) -> DataFrame:
    """Groups of vectors linked by pairs within max_distance: single linkage; see linkage.complete_groups for the other."""
    edges = close_links(vectors, key, vec, max_distance)
    return connected_groups(vectors, edges, key)


def planar(vectors: DataFrame, key: str, vec: str, k: int = 2) -> DataFrame:
    """Centred scores on the first k principal components."""
    v = vectors.select(key, array_to_vector(F.col(vec).cast("array<double>")).alias("features"))
    model = PCA(k=k, inputCol="features", outputCol="scores").fit(v)
    scores = model.transform(v)
    mean = scores.select(Summarizer.mean(F.col("scores")).alias("m")).first()["m"].toArray()
    s = vector_to_array(F.col("scores"))
    return scores.select(key, *[(s[i] - float(mean[i])).alias(f"pc{i + 1}") for i in range(k)])


def kmeans_groups(vectors: DataFrame, key: str, vec: str, k: int = 6, seed: int = 1) -> DataFrame:
    v = vectors.select(key, array_to_vector(F.col(vec).cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(v)
    return model.transform(v).select(key, "cluster")
