"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

Weights are the sources' token shares to the power of an exponent between 0 (all alike) and 1
(as they are), normalised. The exponent is bisected: the one whose weights have a target entropy,
or the smallest whose most repeated source is seen at most `max_repeats` times.

The budget is as many tokens as give the least favoured source one whole pass, so every document
is in the mixture and favoured sources are seen again. A source's tokens are dealt into blocks of
documents by hash. Each pass over a source is a permutation of its blocks; whole passes are taken
while the budget lasts, and of the last pass the first blocks of its permutation, the last of them
up to the document that meets the budget.

Where a block begins in its pass is a prefix sum in two steps, over buckets of the permutation's
order and then inside a bucket, so that no source meets in one task.

Defined cases: a null source is a source of its own; a source without tokens has weight 0 and its
documents are taken once; null text has no tokens; rows may repeat and count each time; an empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinegrade.llm.common import hinted, written

BLOCK_TOKENS = 50_000
_STEPS = 60
_PARTS = 64
NO_SOURCE = "\0"


def word_tokens(text: Column) -> Column:
    """Number of words of a text: maximal runs without ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def weights(tokens: dict[str, int], exponent: float) -> dict[str, float]:
    """Normalised shares to the power of the exponent; 0 for a source without tokens."""
    total = sum(tokens.values())
    raised = {s: (n / total) ** exponent if n else 0.0 for s, n in tokens.items()}
    norm = sum(raised.values())
    return {s: w / norm if norm else 0.0 for s, w in raised.items()}


def entropy(of: dict[str, float]) -> float:
    return -sum(w * math.log(w) for w in of.values() if w)


def most_repeated(tokens: dict[str, int], exponent: float) -> float:
    """Passes over the most favoured source while the least favoured gets one."""
    passes = [w / tokens[s] for s, w in weights(tokens, exponent).items() if w]
    return max(passes) / min(passes) if passes else 1.0


def bisect_exponent(good: Callable[[float], bool]) -> float:
    """Smallest exponent in [0, 1] that is good, if goodness grows with the exponent and 1 is good."""
    low, high = 0.0, 1.0
    if good(low):
        return low
    for _ in range(_STEPS):
        middle = (low + high) / 2
        low, high = (low, middle) if good(middle) else (middle, high)
    return high


def exponent_for(tokens: dict[str, int], max_repeats: float | None = None, target_entropy: float | None = None) -> float:
    """The exponent that meets the limit of repetition, or gives the target entropy, or the larger of the two."""
    wanted = [lambda a: most_repeated(tokens, a) <= max_repeats] if max_repeats is not None else []
    if target_entropy is not None:
        wanted.append(lambda a: entropy(weights(tokens, a)) <= target_entropy)
    return max((bisect_exponent(w) for w in wanted), default=1.0)


def _entropies(shares: DataFrame, exponents: list[float]) -> list[float]:
    """Entropy of the weights for each exponent, from the sources' shares, in one aggregate."""
    raised = [F.pow("share", F.lit(a)) for a in exponents]
    sums = shares.agg(*[F.sum(r).alias(f"s{i}") for i, r in enumerate(raised)], *[F.sum(r * F.log("share")).alias(f"l{i}") for i, r in enumerate(raised)]).first()
    return [math.log(sums[f"s{i}"]) - a * sums[f"l{i}"] / sums[f"s{i}"] for i, a in enumerate(exponents)]


def exponent_of(totals: DataFrame, max_repeats: float | None = None, target_entropy: float | None = None) -> float:
    """exponent_for() of a table of sources with their tokens, which stays distributed.

    The limit of repetition depends on the largest and the smallest source alone. For the entropy the
    interval is cut into _PARTS parts at a time, whose ends are looked at in one pass over the table.
    """
    some = totals.where("tokens > 0")
    ends = some.agg(F.min("tokens").alias("least"), F.max("tokens").alias("most"), F.sum("tokens").alias("total")).first()
    if ends["total"] is None:
        return exponent_for({}, max_repeats, target_entropy)
    found = []
    if max_repeats is not None:
        found.append(exponent_for({"least": ends["least"], "most": ends["most"]}, max_repeats))
    if target_entropy is not None:
        shares = some.select((F.col("tokens") / F.lit(float(ends["total"]))).alias("share"))
        low, high = 0.0, 1.0
        while high - low > 2.0**-_STEPS and low + (high - low) / _PARTS > low:
            tried = [low + (high - low) * i / _PARTS for i in range(_PARTS)]
            first = next((i for i, e in enumerate(_entropies(shares, tried)) if e <= target_entropy), _PARTS)
            if first == 0:
                high = low
                break
            low, high = tried[first - 1], tried[first] if first < _PARTS else high
        found.append(high)
    return max(found, default=1.0)


def source_plan(totals: DataFrame, exponent: float, block_tokens: int) -> DataFrame:
    """source, weight, n_blocks, whole_passes, and rest: the tokens to take of the last pass.

    The budget gives the least favoured source one whole pass. A source without tokens is taken once.
    """
    total = float(totals.agg(F.sum("tokens").alias("n")).first()["n"] or 1)
    raised = totals.withColumn("raised", F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(total), F.lit(exponent))).otherwise(0.0))
    norm = float(raised.agg(F.sum("raised").alias("n")).first()["n"] or 1)
    shares = raised.withColumn("weight", F.col("raised") / F.lit(norm))
    budget = float(shares.where("weight > 0").agg(F.max(F.col("tokens") / F.col("weight")).alias("n")).first()["n"] or 0)
    seen = F.when(F.col("tokens") > 0, F.col("weight") * F.lit(budget) / F.col("tokens")).otherwise(1.0)
    whole = F.floor(seen + 1e-9)
    return shares.select("source", "weight", F.greatest(F.expr(f"tokens div {block_tokens}"), F.lit(1)).cast("long").alias("n_blocks"),
                         whole.cast("long").alias("whole_passes"), F.greatest((seen - whole) * F.col("tokens"), F.lit(0.0)).alias("rest"))


def _prefix(rows: DataFrame, size: str) -> DataFrame:
    """rows with `before`: the sum of `size` over the rows of the same source that come before in `rank`.

    rank is an even 64-bit number; its top bits make buckets, whose sums are prefixed first.
    """
    counted = rows.withColumn("bucket", F.shiftright("rank", 52))
    sums = counted.groupBy("source", "bucket").agg(F.sum(size).alias("bucket_size"))  # 4096 buckets a source at most
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("bucket_before"))
    joined = counted.join(sums, counted["source"].eqNullSafe(sums["s"]) & (counted["bucket"] == sums["b"]))
    inside = Window.partitionBy("source", "bucket").orderBy("rank", "key").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("bucket_before") + F.coalesce(F.sum(size).over(inside), F.lit(0))
    return joined.withColumn("before", before).drop("bucket", "s", "b", "bucket_before")


def _planned(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows with their source's plan and their block."""
    joined = rows.join(plan, "source")
    return joined.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit("block")), "n_blocks"))


def mixture(docs: DataFrame, max_repeats: float | None = 2.0, target_entropy: float | None = None, block_tokens: int = BLOCK_TOKENS,
            id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", tokens: Column | None = None) -> DataFrame:
    """Each row of docs, as the struct `whole`, with its part in the mixture.

    doc_id, source, n_tokens, weight of the source, block (number in its source), and n_passes: how
    often the document is seen. Rows that share an id and a source are seen alike.

    Text is scanned and never shuffled: rows meet the plan of their source, the blocks of the last
    passes (a row for some 50 thousand tokens), and the documents taken of the cut blocks, of which
    each source has one.
    """
    counted = tokens if tokens is not None else word_tokens(F.col(text_col))
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(NO_SOURCE))
    full = docs.select(F.struct("*").alias("whole"), F.col(id_col).alias("doc_id"), source.alias("source"), counted.alias("tokens"))
    rows = written(full.drop("whole"), "tokens")
    totals = written(rows.groupBy("source").agg(F.sum("tokens").alias("tokens")), "sources")
    longest = totals.agg(F.max(F.octet_length("source")).alias("n")).first()["n"] or 0
    plan = written(source_plan(totals, exponent_of(totals, max_repeats, target_entropy), block_tokens), "plan")
    plan = hinted(plan, longest + 100)
    planned = _planned(rows, plan)
    blocks = planned.where("rest > 0").groupBy("source", "block", "whole_passes", "rest").agg(F.sum("tokens").alias("block_tokens"))
    order = F.shiftrightunsigned(F.xxhash64("source", "block", "whole_passes"), 1)
    begins = _prefix(blocks.withColumn("rank", order).withColumn("key", F.col("block")), "block_tokens").where("before < rest")
    left = F.col("rest") - F.col("before")
    begins = written(begins.select("source", "block", left.alias("left"), (F.col("block_tokens") > left).alias("cut")), "blocks")
    cut = hinted(begins.where("cut").select("source", "block", "left"), longest + 100)  # one block of a source at most
    inside = planned.select("doc_id", "source", "block", "tokens").join(cut, ["source", "block"])
    inside = inside.withColumn("rank", F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("order")), 1)).withColumn("key", F.col("doc_id"))
    taken = written(_prefix(inside, "tokens").where("before < left").select("source", "doc_id").distinct(), "taken")
    shown = _planned(full, plan).join(hinted(begins.select("source", "block", "cut"), longest + 100), ["source", "block"], "left")
    some = hinted(taken.select(F.col("source").alias("s"), F.col("doc_id").alias("d"), F.lit(True).alias("in_cut")), longest + 100)
    shown = shown.join(some, (shown["source"] == some["s"]) & shown["doc_id"].eqNullSafe(some["d"]), "left")
    more = F.when(F.coalesce("cut", F.lit(True)), F.coalesce("in_cut", F.lit(False))).otherwise(True)
    return shown.select(
        "whole", "doc_id", F.nullif(F.col("source"), F.lit(NO_SOURCE)).alias("source"), F.col("tokens").alias("n_tokens"),
        "weight", "block", (F.col("whole_passes") + more.cast("long")).alias("n_passes"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """docs with each row as often as the mixture shows it, all columns."""
    passes = F.sequence(F.lit(1), F.col("n_passes").cast("int"))
    return mixture(docs, **how).select("whole", F.explode(passes).alias("pass")).select("whole.*")
