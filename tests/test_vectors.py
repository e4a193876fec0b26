"""Vector pairs, groups and projections against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinegrade.operators import linkage, pivot_tree
from cinegrade.operators import vectors as V
from cinegrade.plans.reasons import key_words, vocabulary_groups, with_reason_tokens


def clustered(n=120, dim=8, seed=3):
    """A third of the vectors lies around one direction; two are equal, one is zero."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x[: n // 3] = np.array([3.0] + [0.0] * (dim - 1)) + rng.normal(scale=0.25, size=(n // 3, dim))
    x[1], x[n - 1] = x[0], 0.0
    return x


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id INT, vec ARRAY<DOUBLE>")


def brute_pairs(x, limit):
    norm = np.linalg.norm(x, axis=1)
    ok = norm > 0
    u = np.where(ok[:, None], x / np.where(ok, norm, 1)[:, None], 0)
    d = 1 - u @ u.T
    return {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if ok[i] and ok[j] and d[i, j] <= limit}


@pytest.mark.parametrize("limit", [0.02, 0.09, 0.5, 1.2])
def test_close_pairs(spark, limit):
    x = clustered()
    got = V.close_pairs(frame(spark, x), "id", "vec", limit, leaf=20).collect()
    assert {(r["a"], r["b"]) for r in got} == brute_pairs(x, limit)
    assert len(got) == len({(r["a"], r["b"]) for r in got})


def test_links_of_a_dense_cluster_are_few(spark):
    """A third of 240 vectors is close to one direction and another third equal: no quadratic output."""
    x = clustered(240)
    x[80:160] = x[100]
    links = V.close_links(frame(spark, x), "id", "vec", 0.3, leaf=30).count()
    assert len(brute_pairs(x, 0.3)) > 5000 and links < 1500


@pytest.mark.parametrize("limit", [0.02, 0.09, 0.3, 0.6])
def test_groups(spark, limit):
    x = clustered()
    x[50:60] = x[50]
    groups = {r["id"]: r["group"] for r in V.vector_groups(frame(spark, x), "id", "vec", limit).collect()}
    parent = list(range(len(x)))

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for a, b in brute_pairs(x, limit):
        ra, rb = sorted((root(a), root(b)))
        parent[rb] = ra
    assert groups == {i: root(i) for i in range(len(x))}


def test_long_chain_and_hub_settle(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)]
    edges = spark.createDataFrame(chain, "a INT, b INT")
    keys = spark.createDataFrame([(i,) for i in [*range(1, 41), *range(100, 160), 500]], "id INT")
    got = {r["id"]: r["group"] for r in V.connected_groups(keys, edges, "id").collect()}
    assert {got[i] for i in range(1, 41)} == {1} and {got[i] for i in range(100, 160)} == {100} and got[500] == 500


def test_planar_equals_svd(spark):
    x = clustered(60, 6)
    rows = sorted(V.planar(frame(spark, x), "id", "vec").collect(), key=lambda r: r["id"])
    got = np.array([[r["pc1"], r["pc2"]] for r in rows])
    centred = x - x.mean(axis=0)
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(centred @ axes[:2].T), atol=1e-9)


def test_kmeans(spark):
    got = V.kmeans_groups(frame(spark, clustered()), "id", "vec", k=6).collect()
    assert len(got) == 120 and {r["cluster"] for r in got} <= set(range(6))


def test_vocabulary_groups_and_key_words(spark):
    reasons = [("rated r for violence and gore",), ("rated pg for drug use",), ("rated r for gore violence",)]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(reasons)], "record_id INT, REASON STRING")
    df = with_reason_tokens(df)
    vectors = spark.createDataFrame(
        [("violence", [1.0, 0.0]), ("gore", [0.99, 0.05]), ("drug", [0.0, 1.0])], "word STRING, vec ARRAY<DOUBLE>"
    )
    groups = {r["word"]: r["group"] for r in vocabulary_groups(df, vectors).collect()}
    assert groups == {"violence": "gore", "gore": "gore", "drug": "drug"}
    assert [r["term"] for r in key_words(df, 2).collect()] == ["gore", "violence"]


def bundles(n, dim=12, seed=4):
    """Tight bundles of 25 vectors each around directions of their own."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 25, dim))
    return np.repeat(centres, 25, axis=0) + rng.normal(scale=0.12, size=(n // 25 * 25, dim))


def test_the_tree_compares_few_pairs_and_more_slowly_than_the_square(spark):
    """Candidates at two sizes: under a tenth of all pairs, and under half of what the square would be for four times the rows."""
    met = {}
    for n in (2000, 8000):
        leaves = pivot_tree.tree(pivot_tree.packed_units(frame(spark, bundles(n)), "id", "vec"), pivot_tree.theta_of(0.09))
        met[n] = pivot_tree.comparisons(leaves)
        assert met[n] < 0.1 * n * n / 2
        assert leaves.where("home").count() == n
    assert met[8000] < 8 * met[2000]


def test_tree_pairs_are_exact_on_bundles(spark):
    x = bundles(1500)
    got = V.close_pairs(frame(spark, x), "id", "vec", 0.09).collect()
    want = brute_pairs(x, 0.09)
    assert {(r["a"], r["b"]) for r in got} == want and len(got) == len(want) > 3000


def test_large_leaves_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(pivot_tree, "BLOCK_HOME", 16)
    monkeypatch.setattr(pivot_tree, "BLOCK_ALL", 40)
    x = clustered()
    for limit in (0.09, 0.6):
        got = V.close_pairs(frame(spark, x), "id", "vec", limit, leaf=1000).collect()
        assert {(r["a"], r["b"]) for r in got} == brute_pairs(x, limit) and len(got) == len(brute_pairs(x, limit))


def test_probable_pairs_reach_their_recall(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 64))
    u = x[:300] / np.linalg.norm(x[:300], axis=1, keepdims=True)
    aside = rng.normal(size=u.shape)
    aside -= (aside * u).sum(axis=1, keepdims=True) * u
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    x[300:] = 0.915 * u + np.sqrt(1 - 0.915**2) * aside  # 300 pairs at a distance of 0.085
    want = brute_pairs(x, 0.09)
    got = {(r["a"], r["b"]) for r in V.probable_pairs(frame(spark, x), "id", "vec").collect()}
    assert len(want) == 300 and got <= want
    assert V.expected_recall(0.09) > 0.95 and len(got) / len(want) > V.expected_recall(0.09) - 0.04


def plain_complete(x, limit):
    """Merge the two groups with the nearest farthest members until none are within the limit."""
    norm = np.linalg.norm(x, axis=1)
    u = np.where(norm[:, None] > 0, x / np.where(norm > 0, norm, 1)[:, None], 0)
    d = 1 - u @ u.T
    d[norm == 0, :] = d[:, norm == 0] = np.inf
    np.fill_diagonal(d, np.inf)
    groups = {i: [i] for i in range(len(x))}
    while True:
        flat = int(np.argmin(d))
        i, j = sorted(divmod(flat, len(x)))
        if not d[i, j] <= limit:
            return {k: min(g) for g in groups.values() for k in g}
        d[i] = d[:, i] = np.maximum(d[i], d[j])
        d[i, i] = d[j] = d[:, j] = np.inf
        groups[i] += groups.pop(j)


@pytest.mark.parametrize(("x", "limit"), [(clustered(500, 8), 0.09), (bundles(500), 0.06), (clustered(120, 3), 0.5)])
def test_complete_linkage_equals_merging_one_by_one(spark, x, limit):
    got = {r["id"]: r["group"] for r in linkage.complete_groups(frame(spark, x), "id", "vec", limit).collect()}
    assert got == plain_complete(x, limit)
    assert 1 < len(set(got.values())) < len(x)


def test_vectors_travel_to_few_blocks(spark, monkeypatch):
    """Before, each vector of a leaf of 5,000 went to seven blocks: to five as one of all, to two as one of its own."""
    ids = spark.range(5000).select(F.col("id").alias("key"), F.lit(b"").alias("u"), F.lit(0).cast("long").alias("node"), F.lit(True).alias("home"))
    monkeypatch.setattr(pivot_tree, "BLOCKS", 4)  # two chunks: three blocks
    dealt = pivot_tree.in_chunks(ids)
    assert dealt.count() == 2 * 5000 and dealt.select("i", "j").distinct().count() == 3


@pytest.mark.parametrize("side", [16, 50, 1000])
def test_chunks_of_any_size_find_the_same(spark, monkeypatch, side):
    monkeypatch.setattr(pivot_tree, "BLOCK_HOME", side)
    x = clustered(150)
    pairs = V.close_pairs(frame(spark, x), "id", "vec", 0.5, leaf=1000).collect()
    assert sorted((r["a"], r["b"]) for r in pairs) == sorted(brute_pairs(x, 0.5))
    links = V.close_links(frame(spark, x), "id", "vec", 0.5, leaf=1000)
    groups = {r["id"]: r["group"] for r in V.connected_groups(frame(spark, x), links, "id").collect()}
    assert all(groups[a] == groups[b] for a, b in brute_pairs(x, 0.5))
