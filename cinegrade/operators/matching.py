"""Closest title within a block (a year), exact, without comparing all pairs of a block.

Two titles can only reach a similarity if they share a minimum number of characters.
Characters become distinct tokens in one order for all titles, rare ones first (see
`character_tokens`). If two titles of lengths la and lb must share t tokens, then the
first la - t + 1 tokens of one and the first lb - t + 1 of the other must have one in
common. Titles therefore meet on (block, la, lb, token) only.

The index that meets holds numbers, no text: the title's number, the token's place and a
128-bit mask of the title's tokens. Two titles share no more tokens than either has less
those whose bits the other lacks, and, where they first meet at places i and j, no more
than are left from there; both bounds drop pairs inside the join. Pairs that are left
meet once by their numbers, and only then fetch their tokens for the exact count and their
texts for the score. A key with many titles on both sides (a hot year) is dealt as a grid:
each side in parts of at most CELL_ROWS rows, each part of one side with each of the other.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinegrade.functions.similarity import character_tokens, edit_similarity, sequence_ratio
from cinegrade.session import written

_SLACK = 1e-9  # keeps floating point from raising a bound
CELL_ROWS = 1024  # rows of either side of one key that meet in one cell
PAIRS_PER_TASK = 4096
_KEY = ("la", "lb", "token")


class Similarity:
    """A similarity with bounds: partner lengths and shared characters it needs."""

    def __init__(
        self,
        score: Callable[[Column, Column], Column],
        needed: Callable[[Column, Column, float], Column],
        length_factor: Callable[[float], float],
    ):
        self.score = score  # (candidate, title) -> similarity
        self.needed = needed  # (len a, len b, cutoff) -> characters to share
        self.length_factor = length_factor  # cutoff -> largest ratio of the two lengths


RATIO = Similarity(
    score=sequence_ratio,
    needed=lambda la, lb, cutoff: F.ceil((la + lb) * (cutoff / 2) - _SLACK),
    length_factor=lambda cutoff: (2 - cutoff) / cutoff,
)
EDIT = Similarity(
    score=edit_similarity,
    needed=lambda la, lb, cutoff: F.ceil(F.greatest(la, lb) * cutoff - _SLACK),
    length_factor=lambda cutoff: 1 / cutoff,
)


def _head_size(own: str, sim: Similarity, cutoff: float) -> Column:
    """Number of leading tokens among which a partner must share one."""
    needed = F.greatest(sim.needed(F.col("la"), F.col("lb"), cutoff), F.lit(1))
    return F.greatest((F.col(own) - needed + 1).cast("int"), F.lit(0))


def _frequent_tokens(titles: DataFrame, n: int = 64) -> list[int]:
    """The n most frequent character tokens, the most frequent one last."""
    tokens = titles.select(F.explode(character_tokens(F.col("text"))).alias("t"))
    top = tokens.groupBy("t").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "t").limit(n)
    return [r["t"] for r in reversed(top.collect())]


def _mask(tokens: Column, low: int) -> Column:
    """The bits low .. low + 63 of a 128-bit set of tokens."""
    place = lambda t: F.pmod(F.xxhash64(t), F.lit(128)) - low
    bit = lambda t: F.call_function("shiftleft", F.lit(1).cast("long"), place(t).cast("int"))
    own = F.filter(tokens, lambda t: (place(t) >= 0) & (place(t) < 64))
    return F.aggregate(own, F.lit(0).cast("long"), lambda mask, t: mask.bitwiseOR(bit(t)))


def _numbered(titles: DataFrame, block: str, side: str, common: list[int] | None = None) -> DataFrame:
    """Distinct titles with a number, their tokens, their length and the mask of the tokens, written once."""
    t = titles.select(block, "text", character_tokens(F.col("text"), common).alias("toks"))
    return written(
        t.select(
            block,
            F.monotonically_increasing_id().alias(f"id_{side}"),
            F.col("text").alias(f"text_{side}"),
            F.col("toks").alias(f"toks_{side}"),
            F.size("toks").alias(f"l{side}"),
            _mask(F.col("toks"), 0).alias(f"low_{side}"),
            _mask(F.col("toks"), 64).alias(f"high_{side}"),
        ),
        f"titles-{side}",
    )


def _signatures(titles: DataFrame, partners: DataFrame, block: str, sim: Similarity, cutoff: float, side: str) -> DataFrame:
    """One row of numbers per leading token of each title and length that partners of its block have."""
    own, other = f"l{side}", "lb" if side == "a" else "la"
    factor = sim.length_factor(cutoff)
    longest = F.greatest(own, other) <= F.least(own, other) * factor + _SLACK
    lengths = partners.groupBy(block).agg(F.collect_set(other).alias("others"))  # distinct lengths, not titles
    t = titles.join(lengths, block).withColumn(other, F.explode("others")).where(longest)
    head = F.slice(f"toks_{side}", F.lit(1), _head_size(own, sim, cutoff))
    numbers = [block, "la", "lb", f"id_{side}", f"low_{side}", f"high_{side}"]
    return t.select(*numbers, F.posexplode(head).alias(f"place_{side}", "token"))


def _hot_keys(a: DataFrame, b: DataFrame, block: str) -> DataFrame:
    """Keys with more than CELL_ROWS rows on a side, with the number of parts of each side.

    A side has fewer such keys than its rows / CELL_ROWS.
    """
    key = [block, *_KEY]
    sides = a.select(*key, F.lit(1).alias("a")).unionByName(b.select(*key, F.lit(0).alias("a")))
    counts = sides.groupBy(*key).agg(F.sum("a").alias("n_a"), F.sum(1 - F.col("a")).alias("n_b"))
    hot = counts.where((F.least("n_a", "n_b") > 0) & (F.greatest("n_a", "n_b") > CELL_ROWS))
    parts = lambda n: F.ceil(F.col(n) / CELL_ROWS).cast("int")
    return written(hot.select(*key, parts("n_a").alias("parts_a"), parts("n_b").alias("parts_b")), "hot-keys")


def _in_cells(rows: DataFrame, hot: DataFrame, block: str, side: str) -> DataFrame:
    """rows with the cells of their key's grid they belong to: one part of their own side, every part of the other."""
    own, other = f"parts_{side}", "parts_b" if side == "a" else "parts_a"
    at = F.pmod(F.xxhash64(f"id_{side}", F.lit(side)), F.coalesce(own, F.lit(1)).cast("long")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))
    cells = (at.alias("cell_a"), every.alias("cell_b")) if side == "a" else (every.alias("cell_a"), at.alias("cell_b"))
    return rows.join(hot, [block, *_KEY], "left").select(*rows.columns, *cells)


def candidate_pairs(a: DataFrame, b: DataFrame, block: str, sim: Similarity, cutoff: float) -> DataFrame:
    """(id_a, id_b), each pair once, of all titles of `_numbered` that can reach the cutoff by the bounds of the index."""
    left, right = _signatures(a, b, block, sim, cutoff, "a"), _signatures(b, a, block, sim, cutoff, "b")
    hot = _hot_keys(left, right, block)
    lacking = lambda x, y: sum(F.bit_count(F.col(f"{h}_{x}").bitwiseAND(F.bitwise_not(f"{h}_{y}"))) for h in ("low", "high"))
    most = F.least(
        F.col("la") - lacking("a", "b"), F.col("lb") - lacking("b", "a"),
        F.col("la") - F.col("place_a"), F.col("lb") - F.col("place_b"),
    )
    met = _in_cells(left, hot, block, "a").join(_in_cells(right, hot, block, "b"), [block, *_KEY, "cell_a", "cell_b"])
    return met.where(most >= sim.needed(F.col("la"), F.col("lb"), cutoff)).select("id_a", "id_b").distinct()


def scored_pairs(a: DataFrame, b: DataFrame, block: str, sim: Similarity, cutoff: float) -> DataFrame:
    """(block, id_a, text, candidate) of the candidate pairs that share enough characters: those that get a score."""
    pairs = written(candidate_pairs(a, b, block, sim, cutoff), "pairs")
    tasks = max(1, -(-pairs.count() // PAIRS_PER_TASK))  # small rows, costly scores: by number, not by bytes
    pairs = pairs.repartitionByRange(tasks, "id_a", "id_b").sortWithinPartitions("id_a")
    pairs = pairs.join(a.drop("low_a", "high_a"), "id_a").join(b.select("id_b", "text_b", "toks_b", "lb"), "id_b")
    shared = F.size(F.array_intersect("toks_a", "toks_b"))
    pairs = pairs.where(shared >= sim.needed(F.col("la"), F.col("lb"), cutoff))
    return pairs.select(block, "id_a", F.col("text_a").alias("text"), F.col("text_b").alias("candidate"))


def _best_scored(a: DataFrame, b: DataFrame, block: str, sim: Similarity, cutoff: float) -> DataFrame:
    """Best candidate per (block, text) with similarity >= cutoff."""
    scored = scored_pairs(a, b, block, sim, cutoff).withColumn("score", sim.score(F.col("candidate"), F.col("text")))
    best = F.max(F.struct("score", "candidate")).alias("best")
    return scored.where(F.col("score") >= cutoff).groupBy("id_a", block, "text").agg(best)


def closest_titles(
    targets: DataFrame,
    candidates: DataFrame,
    block: str,
    title: str,
    candidate: str,
    sim: Similarity = RATIO,
    cutoff: float = 0.6,
    strict_cutoff: float | None = 0.8,
) -> DataFrame:
    """Targets with the closest candidate title of the same block and its score.

    Equal scores go to the larger string; without a match the title is '' and the score
    null. Both sides are reduced to distinct titles first and written once to the shared
    folder, so that the stages do not read the source tables again. Equal titles are paired by a
    plain join; the rest is tried at `strict_cutoff`, where signatures are few, and only
    what is left is tried at `cutoff`. A match found at a higher cutoff beats all below
    it, so the stages change the cost and not the result.
    """
    pool = candidates.select(block, F.col(candidate).alias("text")).where(F.col("text") != "")
    pool = written(pool.distinct(), "pool")
    todo = targets.select(block, F.col(title).alias("text")).where(F.col("text") != "").distinct()
    todo = written(todo.join(pool.withColumn("equal", F.lit(True)), [block, "text"], "left"), "targets")
    same = F.struct(F.lit(1.0).alias("score"), F.col("text").alias("candidate")).alias("best")
    found = [todo.where("equal").select(block, "text", same)]
    common = _frequent_tokens(pool)
    a, b = _numbered(todo.where("equal IS NULL"), block, "a", common), _numbered(pool, block, "b", common)
    if strict_cutoff is not None and strict_cutoff > cutoff:
        close = written(_best_scored(a, b, block, sim, strict_cutoff), "close")
        found.append(close.drop("id_a"))
        a = a.join(close.select("id_a"), "id_a", "left_anti")
    found.append(_best_scored(a, b, block, sim, cutoff).drop("id_a"))
    matched = reduce(DataFrame.unionByName, found).select(
        block,
        F.col("text").alias(title),
        F.col("best.candidate").alias("closest"),
        F.col("best.score").alias("score"),
    )
    return targets.join(matched, [block, title], "left").withColumn(
        "closest", F.coalesce("closest", F.lit(""))
    )
