"""The metric-space join against brute force, and its parts against their definitions."""

import random
import re
from itertools import combinations

import numpy as np
import pytest

from cinegrade.llm import jaccard_join as J
from cinegrade.llm.components import components


def brute(rows, words_each, t):
    """doc_id -> (size, smallest linked id) by comparing all pairs."""
    sets, parent = {}, {}
    for i, (_, text) in enumerate(rows):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        width = min(words_each, len(words))
        sets[i] = {tuple(words[k : k + width]) for k in range(len(words) - width + 1)} if words else set()
        parent[i] = i

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(sets, 2):
        both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if sets[a] and sets[b] and t[1] * both >= t[0] * either:
            parent[root(a)] = root(b)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return sorted(((d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def groups(spark, rows, words_each, t):
    docs = spark.createDataFrame([(d, x, "clash") for d, x in rows], "doc_id long, text string, sig string")
    return sorted((tuple(r) for r in J.jaccard_groups(docs, words_each, t).collect()), key=str)


def corpus(seed, n_bases=12, copies=12, length=60):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    common = " ".join(draw.choices(vocabulary, k=12))
    texts = []
    for _ in range(n_bases):
        base = draw.choices(vocabulary, k=draw.randint(8, length))
        for _ in range(draw.randint(1, copies)):
            words = list(base)
            for _ in range(draw.randint(0, 3)):
                words[draw.randrange(len(words))] = draw.choice(vocabulary)
            texts.append((" ".join(words) + (" " + common if draw.random() < 0.3 else "")).title())
    texts += [None, "", "  \n ", "one", "ONE", "one two", "a b c", "a b c d"]
    draw.shuffle(texts)
    return [(i * 3, x) for i, x in enumerate(texts)]


@pytest.mark.parametrize(("seed", "words_each", "t"), [(1, 3, (9, 10)), (2, 5, (4, 5)), (3, 3, (4, 5))])
def test_groups_equal_brute_force(spark, seed, words_each, t):
    rows = corpus(seed)
    assert groups(spark, rows, words_each, t) == brute(rows, words_each, t)


def test_recursion_and_hot_regions_equal_brute_force(spark, monkeypatch):
    """Small bounds send most groups through consensus pivots, stars and the regions below them."""
    rows = corpus(4, n_bases=4, copies=60, length=40)
    for name, value in (("LEAF", 4), ("REGION", 3), ("HOT", 4), ("HOT_LOCAL", 2)):
        monkeypatch.setattr(J, name, value)
    assert groups(spark, rows, 3, (9, 10)) == brute(rows, 3, (9, 10))


def test_regions_of_near_copies_are_fetched_once(spark):
    """Two long sets share hundreds of regions: they go on as one group, not as one for each region."""
    draw = np.random.default_rng(8)
    x, y, z = (draw.integers(1, 2**62, 3_000) for _ in range(3))
    sets = {1: x, 2: np.concatenate([x[:-50], y[:50]]), 3: np.concatenate([y[:2_000], x[:1_000]]), 4: z}
    rows = [(0, sig, len(e), np.sort(e).tolist(), len(sets)) for sig, e in sets.items()]
    members = spark.createDataFrame(rows, "group long, sig long, n long, elements array<long>, size long")
    _, below = J._recursed(members, (9, 10))
    assert sorted(r["sig"] for r in below.collect()) == [1, 2]


def test_wide_regions_link_only_what_may_be_close(spark):
    draw = np.random.default_rng(4)
    sets = [np.unique(draw.integers(0, 1 << 63, 40 + k % 3, dtype=np.uint64)) for k in range(J.REGION + 40)]
    sets[9], sets[11] = sets[5][:-1], np.append(sets[5][1:], np.uint64(7))
    wide = [(1, k, len(x), 0) for k, x in enumerate(sets)]
    words = ", ".join(f"b{k} bigint" for k in range(8))
    classes = spark.createDataFrame(
        [(k, len(x), bytearray(J._fine_sketch(x)) if J._fine_sketch(x) else None, *J._sketch(x).tolist()) for k, x in enumerate(sets)],
        f"sig bigint, n bigint, sketch binary, {words}")
    regions = spark.createDataFrame(wide, "element bigint, sig bigint, n int, rank int")
    found = {frozenset((r["u"], r["v"])) for r in J._candidate_edges(regions, classes, (9, 10)).collect()}
    assert len(found) == 2 and set().union(*found) == {5, 9, 11}


@pytest.mark.parametrize("t", [(4, 5), (9, 10)])
def test_forests_of_wide_regions_equal_brute_force(spark, monkeypatch, t):
    rows = corpus(21) + [(10_000 + k, x) for k, (_, x) in enumerate(corpus(22, n_bases=2, copies=8, length=1500))]
    want = brute(rows, 2, t)
    monkeypatch.setattr(J, "REGION", 1)
    assert groups(spark, rows, 2, t) == want


def test_repeated_rows_in_recursion_equal_brute_force(spark, monkeypatch):
    """Rows with the same id and text, and copies without ids, count once in the windows of large groups."""
    draw = random.Random(11)
    rows = []
    for i, text in corpus(4, n_bases=4, copies=60, length=40):
        i = None if i % 4 == 0 else i
        rows += [(i, text)] * draw.choice((1, 4, 9))
    for name, value in (("LEAF", 4), ("REGION", 3), ("HOT", 4), ("HOT_LOCAL", 2)):
        monkeypatch.setattr(J, name, value)
    assert groups(spark, rows, 3, (9, 10)) == brute(rows, 3, (9, 10))
    assert groups(spark, rows, 3, (4, 5)) == brute(rows, 3, (4, 5))


def test_hot_list_bound_changes_no_result(spark, monkeypatch):
    rows = corpus(5)
    monkeypatch.setattr(J, "HOT_LIST", 1)
    monkeypatch.setattr(J, "HOT", 2)
    monkeypatch.setattr(J, "HOT_LOCAL", 1)
    assert groups(spark, rows, 3, (9, 10)) == brute(rows, 3, (9, 10))


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(5, "a b c d e"), (5, "a b c d e"), (None, "a b c d e"), (7, "x y z"), (None, None)]
    assert groups(spark, rows, 3, (9, 10)) == sorted([(5, 3, 5), (5, 3, 5), (None, 3, 5), (7, 1, 7), (None, 0, None)], key=str)
    assert groups(spark, [], 3, (9, 10)) == []


def test_long_text_with_one_change_is_linked(spark):
    words = [f"v{i % 7919}x{i}" for i in range(30_000)]
    changed = list(words)
    changed[15_000] = "other"
    rows = [(1, " ".join(words)), (2, " ".join(changed)), (3, " ".join(words[:20_000]))]
    assert groups(spark, rows, 3, (9, 10)) == [(1, 29_998, 1), (2, 29_998, 1), (3, 19_998, 3)]


def test_sketches_are_never_farther_apart_than_sets():
    draw = np.random.default_rng(6)
    for n in (3, 600, 2_000, 9_000):
        x = np.unique(draw.integers(0, 2**63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[: n // 2], draw.integers(0, 2**63, n // 3).astype(np.uint64)]))
        apart = len(np.setxor1d(x, y))
        assert int(np.bitwise_count(J._sketch(x).view(np.uint64) ^ J._sketch(y).view(np.uint64)).sum()) <= apart
        if n > 1_500:
            assert J._sketch_distance(J._fine_sketch(x), J._fine_sketch(y)) <= apart


def test_links_within_is_invariant_under_a_pivot():
    draw = np.random.default_rng(7)
    base = np.arange(100)
    sets = [np.setxor1d(base, draw.choice(120, draw.integers(1, 9), replace=False)) for _ in range(40)]
    sizes = np.array([len(s) for s in sets])
    plain = J.links_within(sizes, sets, (9, 10))
    moved = J.links_within(sizes, [np.setxor1d(s, base) for s in sets], (9, 10))
    assert sorted(plain) == sorted(moved) and plain


def test_drop_near_copies_keeps_columns_and_smallest(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text, "g"), (2, text + " more", "h"), (3, "quite another text of its own here", "k")], "doc_id long, text string, gone string")
    kept = J.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_components_of_chains_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, k) for k in range(101, 130)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(found[i] == 0 for i in range(51)) and all(found[k] == 100 for k in range(100, 130))
    assert found[202] == 200 and 300 not in found
