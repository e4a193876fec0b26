"""Closest titles against brute force: difflib for the ratio, a plain matrix for edits."""

import difflib
import random

import pytest

from cinegrade.catalog import matching as queries
from cinegrade.functions.similarity import relative_distance
from cinegrade.operators.joins import merge_titles
from cinegrade.operators import matching
from cinegrade.operators.matching import EDIT, RATIO, closest_titles

WORDS = "red blue night return king the of lost star war love last man iron day queen ring".split()


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def misspell(rng, title):
    chars = list(title)
    for _ in range(rng.randrange(4)):
        i = rng.randrange(len(chars))
        chars[i : i + 1] = rng.choice([[], [rng.choice("abcxyz")], [chars[i], chars[i]]])
        chars = chars or ["a"]
    return "".join(chars)


def sample(seed=5, n=160):
    """Half of all titles fall into one year."""
    rng = random.Random(seed)
    year = lambda: 1999 if rng.random() < 0.5 else rng.randrange(1990, 1995)
    films = [(year(), " ".join(rng.sample(WORDS, rng.randrange(1, 5)))) for _ in range(n)]
    targets = [(y, misspell(rng, t) if rng.random() < 0.7 else t) for y, t in films]
    targets += [(1999, "zzzz qqqq"), (1999, "x"), (2001, "no such year"), (1999, films[0][1])]
    films += [(1999, "an ab"), (1999, "ab an"), (1999, "")]
    return targets + [(1999, "ab"), (1999, "")], films


def frames(spark, targets, films):
    return spark.createDataFrame(targets, "year INT, TITLE STRING"), spark.createDataFrame(films, "year INT, film STRING")


@pytest.mark.parametrize("strict", [0.8, None])
def test_ratio_equals_difflib(spark, strict):
    targets, films = sample()
    got = closest_titles(*frames(spark, targets, films), "year", "TITLE", "film", RATIO, strict_cutoff=strict)
    for row in got.collect():
        pool = [f for y, f in films if y == row["year"] and f]
        want = difflib.get_close_matches(row["TITLE"], pool) if row["TITLE"] else []
        assert row["closest"] == (want[0] if want else ""), row
    assert got.count() == len(targets)


def test_edit_equals_brute_force(spark):
    targets, films = sample(seed=8)
    got = closest_titles(*frames(spark, targets, films), "year", "TITLE", "film", EDIT).collect()
    assert len(got) == len(targets)
    for row in got:
        scored = [
            (1 - edit_distance(row["TITLE"], f) / max(len(f), len(row["TITLE"])), f)
            for y, f in films if y == row["year"] and f and row["TITLE"]
        ]
        best = max([s for s in scored if s[0] >= 0.6], default=(None, ""))
        assert row["closest"] == best[1], (row, best)


def test_lower_cutoff(spark):
    targets, films = sample(seed=9, n=40)
    got = closest_titles(*frames(spark, targets, films), "year", "TITLE", "film", RATIO, cutoff=0.4)
    for row in got.where("TITLE <> ''").collect():
        want = difflib.get_close_matches(row["TITLE"], [f for y, f in films if y == row["year"] and f], cutoff=0.4)
        assert row["closest"] == (want[0] if want else "")


def test_relative_distance(spark):
    df = spark.createDataFrame([("jaws", "jaw"), ("jaws", "")], "a STRING, b STRING")
    got = [r[0] for r in df.select(relative_distance(df.a, df.b)).collect()]
    assert got == [1 / 4, 4.0]


def test_merge_titles_with_and_without_year(spark):
    targets = spark.createDataFrame([(1, "a", "a1", "f"), (1, "b", "", "")], "year INT, TITLE STRING, MovieName STRING, film STRING")
    subs = spark.createDataFrame([(1, "a1", 10), (2, "a1", 20), (1, "", 30)], "year INT, MovieName STRING, sub INT")
    films = spark.createDataFrame([(1, "f", 7), (1, "", 8)], "year INT, film STRING, fid INT")
    rows = lambda df: sorted(((r["TITLE"], r["sub"], r["fid"]) for r in df.collect()), key=str)
    assert rows(merge_titles(targets, subs, films)) == [("a", 10, 7), ("b", None, None)]
    loose = merge_titles(targets, subs.drop("year"), films.drop("year"), year=None)
    assert rows(loose) == [("a", 10, 7), ("a", 20, 7), ("b", None, None)]


def test_ratio_of_all_parts_equals_difflib(spark, sf_dir):
    pools = {}
    for row in queries._subtitles(spark, sf_dir).collect():
        pools.setdefault(row["year"], []).append(row["MovieName"])
    got = queries.closest_title_ratio(spark, sf_dir).collect()
    assert len(got) == queries._targets(spark, sf_dir).count()
    for row in got:
        want = difflib.get_close_matches(row["TITLE"], pools[row["year"]])
        assert row["closest"] == (want[0] if want else ""), row
        if want:
            assert row["score"] == round(difflib.SequenceMatcher(None, want[0], row["TITLE"]).ratio(), 9)


def hot_year(spark, n):
    """Titles of one year only, and their pairs that can reach the cutoff."""
    rng = random.Random(3)
    films = sorted({" ".join(rng.sample(WORDS, rng.randrange(1, 5))) for _ in range(n)})
    targets = sorted({misspell(rng, f) for f in films})
    frame = lambda titles: spark.createDataFrame([(1999, t) for t in titles], "year INT, text STRING")
    common = matching._frequent_tokens(frame(films))
    a, b = (matching._numbered(frame(t), "year", side, common) for t, side in ((targets, "a"), (films, "b")))
    return targets, films, a, b


@pytest.mark.parametrize("sim", [RATIO, EDIT], ids=["ratio", "edit"])
def test_hot_year_in_cells(spark, monkeypatch, sim):
    """A grid of small cells gives each pair of the plain join once, and every pair that reaches the cutoff."""
    targets, films, a, b = hot_year(spark, 250)
    plain = {tuple(r) for r in matching.candidate_pairs(a, b, "year", sim, 0.6).collect()}
    monkeypatch.setattr(matching, "CELL_ROWS", 4)
    left, right = matching._signatures(a, b, "year", sim, 0.6, "a"), matching._signatures(b, a, "year", sim, 0.6, "b")
    assert matching._hot_keys(left, right, "year").where("parts_a > 1 AND parts_b > 1").count() > 0
    dealt = matching.candidate_pairs(a, b, "year", sim, 0.6).collect()
    assert len(dealt) == len(plain) and {tuple(r) for r in dealt} == plain
    scored = {(r["text"], r["candidate"]) for r in matching.scored_pairs(a, b, "year", sim, 0.6).collect()}
    ratio = lambda t, f: difflib.SequenceMatcher(None, f, t).ratio()
    edit = lambda t, f: 1 - edit_distance(t, f) / max(len(t), len(f))
    score = ratio if sim is RATIO else edit
    assert {(t, f) for t in targets for f in films if t and score(t, f) >= 0.6} <= scored


@pytest.mark.parametrize("sim", [RATIO, EDIT], ids=["ratio", "edit"])
def test_one_year_scores_few_pairs(spark, monkeypatch, sim):
    """What a search scores of one year, as counted in its steps: fewer than a tenth of the year's pairs."""
    targets, films, _, _ = hot_year(spark, 400)
    counts, plain = [], matching.scored_pairs

    def counted(*args):
        pairs = plain(*args)
        counts.append(pairs.count())
        return pairs

    monkeypatch.setattr(matching, "scored_pairs", counted)
    closest_titles(*frames(spark, [(1999, t) for t in targets], [(1999, f) for f in films]), "year", "TITLE", "film", sim)
    assert len(counts) == 2 and sum(counts) < len(targets) * len(films) / 10


def test_empty_and_null_titles(spark):
    """Nulls and empty titles match nothing, an empty table gives no rows, and the rows of the targets all stay."""
    empty = spark.createDataFrame([], "year INT, TITLE STRING")
    films = spark.createDataFrame([(1999, "jaws"), (None, "jaws"), (1999, None), (1999, "")], "year INT, film STRING")
    targets = spark.createDataFrame([(1999, "jaws"), (1999, "jaws"), (None, "jaws"), (1999, None), (1999, "")], "year INT, TITLE STRING")
    assert closest_titles(empty, films, "year", "TITLE", "film", EDIT).count() == 0
    got = sorted(((r["year"], r["TITLE"], r["closest"]) for r in closest_titles(targets, films, "year", "TITLE", "film", EDIT).collect()), key=str)
    assert got == sorted([(1999, "jaws", "jaws")] * 2 + [(None, "jaws", ""), (1999, None, ""), (1999, "", "")], key=str)
    none = closest_titles(targets, films.limit(0), "year", "TITLE", "film", EDIT)
    assert {r["closest"] for r in none.collect()} == {""}
