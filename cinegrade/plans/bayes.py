"""Multinomial naive Bayes as relational algebra.

The parameters are grouped sums and the prediction is a join, so neither the vocabulary
nor the model passes through the driver, and terms keep their names. On equal features
the values equal those of spark.ml's NaiveBayes.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinegrade.functions.text import counted_terms
from cinegrade.operators.splits import with_fold
from cinegrade.operators.terms import term_counts
from cinegrade.session import broadcast_if_small, cut_lineage


def priors(docs: DataFrame, classes: Sequence[str], label: str, smoothing: float = 1.0) -> dict[str, float]:
    """Log prior per class: one small row."""
    counts = docs.agg(*[F.count_if(F.col(label) == c).alias(c) for c in classes]).first().asDict()
    total = sum(counts.values()) + smoothing * len(classes)
    return {c: math.log((counts[c] + smoothing) / total) for c in classes}


def term_parameters(
    docs: DataFrame, classes: Sequence[str], label: str, tokens: str, smoothing: float = 1.0
) -> DataFrame:
    """(term, one log likelihood column per class).

    The counts per term are written once: their totals are needed before the logarithms.
    """
    per_term = cut_lineage(
        docs.select(label, F.inline(counted_terms(F.col(tokens))))
        .groupBy("term")
        .agg(*[F.sum(F.when(F.col(label) == c, F.col("n")).otherwise(0)).alias(c) for c in classes])
    )
    totals = per_term.agg(F.count("*").alias("terms"), *[F.sum(c).alias(c) for c in classes]).first()
    size = totals["terms"] * smoothing
    return per_term.select(
        "term",
        *[F.log((F.col(c) + smoothing) / F.lit((totals[c] or 0) + size)).alias(c) for c in classes],
    )


def predict(
    docs: DataFrame, params: DataFrame, prior: dict[str, float], key: str, tokens: str
) -> DataFrame:
    """(key, prediction, one score column per class); unknown terms carry no weight.

    A parameter table that its count shows to be small is broadcast; each document is then
    summed on the map side.
    """
    classes = list(prior)
    params = broadcast_if_small(params)
    likelihood = (
        term_counts(docs, key, tokens)
        .join(params, "term")
        .groupBy(key)
        .agg(*[F.sum(F.col("n") * F.col(c)).alias(c) for c in classes])
    )
    scores = docs.select(key).join(likelihood, key, "left")
    scored = scores.select(key, *[(F.coalesce(c, F.lit(0.0)) + prior[c]).alias(c) for c in classes])
    best = F.greatest(*classes) if len(classes) > 1 else F.col(classes[0])
    first = F.coalesce(*[F.when(F.col(c) == best, c) for c in classes])
    return scored.withColumn("prediction", first)


def out_of_fold(
    docs: DataFrame, classes: Sequence[str], label: str, tokens: str, key: str, k: int, smoothing: float = 1.0
) -> DataFrame:
    """(key, fold, label, prediction, one score column per class): each row by the model of the other folds.

    One scan counts the terms for all models and one scores the rows: a term holds an array with the
    likelihoods of every model, and a row reads its own. A term that the other folds lack carries no weight.
    """
    rows = with_fold(docs, key, k)

    def inside(c: str, f: int):
        return (F.col(label) == c) & (F.col("fold") != f)

    cells = {(c, f): f"c{i}_{f}" for i, c in enumerate(classes) for f in range(k)}
    per_term = cut_lineage(
        rows.select(label, "fold", F.inline(counted_terms(F.col(tokens))))
        .groupBy("term")
        .agg(*[F.sum(F.when(inside(c, f), F.col("n")).otherwise(0)).alias(name) for (c, f), name in cells.items()])
    )
    seen = [F.greatest(*[F.col(cells[c, f]) for c in classes]) > 0 for f in range(k)]
    totals = per_term.agg(*[F.count_if(s).alias(f"v{f}") for f, s in enumerate(seen)], *[F.sum(n).alias(n) for n in cells.values()]).first()

    def likelihood(c: str, f: int):
        name = cells[c, f]
        return F.log((F.col(name) + smoothing) / F.lit((totals[name] or 0) + totals[f"v{f}"] * smoothing))

    models = [F.when(seen[f], F.struct(*[likelihood(c, f).alias(c) for c in classes])) for f in range(k)]
    params = broadcast_if_small(per_term.select("term", F.array(*models).alias("models")))
    counts = rows.agg(*[F.count_if(inside(c, f)).alias(name) for (c, f), name in cells.items()]).first()

    def log_prior(c: str, f: int) -> float:
        return math.log((counts[cells[c, f]] + smoothing) / (sum(counts[cells[x, f]] for x in classes) + smoothing * len(classes)))

    model = F.get("models", F.col("fold"))
    summed = (
        rows.select(key, "fold", F.inline(counted_terms(F.col(tokens))))
        .join(params, "term")
        .groupBy(key)
        .agg(*[F.sum(F.col("n") * model[c]).alias(c) for c in classes])
    )
    scored = rows.select(key, "fold", label).join(summed, key, "left")
    prior = {c: F.get(F.array(*[F.lit(log_prior(c, f)) for f in range(k)]), F.col("fold")) for c in classes}
    scored = scored.select(key, "fold", label, *[(F.coalesce(c, F.lit(0.0)) + prior[c]).alias(c) for c in classes])
    best = F.greatest(*classes) if len(classes) > 1 else F.col(classes[0])
    return scored.withColumn("prediction", F.coalesce(*[F.when(F.col(c) == best, F.lit(c)) for c in classes]))
