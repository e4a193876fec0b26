"""Out-of-fold blending: predictions of a first layer of models as features for all rows.

Per category the labelled rows fall into k folds by the hash of their key, and k models
are fitted, each on k - 1 folds. A labelled row takes the probability from the model that
has not seen it; a row without a label takes the mean of all k models.

All rows pass all models in one scan: words are hashed once, and the models sit side by
side as columns on the row. So there is no union of fold outputs, no join of holdout
scores per fold, and no join of the categories into a wide frame.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from operator import or_

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinegrade.fixed_values import BLEND_FOLDS
from cinegrade.operators.scores import confusion_rates
from cinegrade.operators.splits import key_hash
from cinegrade.plans.ratings import probability, shared_stages
from cinegrade.plans.search import cv_scores, mean_scores
from cinegrade.session import broadcast_if_small, cut_lineage


def fold_of(key: str, label: str, k: int, seed: int) -> Column:
    """Fold of a labelled row, null for a row without a label."""
    return F.when(F.col(label).isNotNull(), (key_hash(F.col(key), seed) % k).cast("int"))


def fit_folds(
    rows: DataFrame, pipeline: Pipeline, key: str, label: str, k: int = BLEND_FOLDS, seed: int = 1, parallelism: int = 5
) -> list[PipelineModel]:
    """k models; model i has not seen fold i. Every stage of `pipeline`, IDF included, is refitted."""
    labelled = rows.where(F.col(label).isNotNull())
    labelled = labelled.withColumns({"label": F.col(label).cast("double"), "fold": fold_of(key, label, k, seed)}).persist()
    try:
        labelled.count()
        with ThreadPoolExecutor(parallelism) as pool:
            return list(pool.map(lambda i: pipeline.fit(labelled.where(F.col("fold") != i)), range(k)))
    finally:
        labelled.unpersist()


def with_probabilities(rows: DataFrame, models: Sequence[PipelineModel], prefix: str) -> DataFrame:
    """Rows with one positive-class probability column per model."""
    keep = rows.columns
    for i, model in enumerate(models):
        name = f"{prefix}{i}"
        rows = model.transform(rows).select(*keep, probability(1).alias(name))
        keep = [*keep, name]
    return rows


def blended(names: Sequence[str], fold: Column) -> Column:
    """Out-of-fold value for a labelled row, mean of all models otherwise."""
    own = F.get(F.array(*names), fold)
    mean = sum((F.col(n) for n in names[1:]), F.col(names[0])) / len(names)
    return F.when(fold.isNotNull(), own).otherwise(mean)


def blend_all(
    rows: DataFrame, pipeline: Pipeline, key: str, labels: Sequence[str], k: int = BLEND_FOLDS, seed: int = 1
) -> DataFrame:
    """(key, one blended feature per label column) for all rows, labelled or not.

    `rows` has the token column `bow` and one nullable 0/1 column per category.
    """
    shared, fitted_part = shared_stages(pipeline)
    scored = shared.transform(rows.select(key, "bow", *labels)).drop("bow", "words")
    hashed, columns = scored.where(reduce(or_, [F.col(label).isNotNull() for label in labels])).persist(), []
    try:
        for label in labels:
            models = fit_folds(hashed, fitted_part, key, label, k, seed)
            scored = with_probabilities(scored, models, f"{label}_p")
            names = [f"{label}_p{i}" for i in range(k)]
            columns.append(blended(names, fold_of(key, label, k, seed)).alias(label))
    finally:
        hashed.unpersist()
    return scored.select(key, *columns)


def dimension_scores(rows: DataFrame, pipeline: Pipeline, key: str, labels: Sequence[str], k: int = 3, seed: int = 1) -> DataFrame:
    """Accuracy, precision and rates of each dimension's model, every labelled row judged by the model that has not seen its fold."""
    rows = rows.where(reduce(or_, [F.col(label).isNotNull() for label in labels]))
    scored = blend_all(rows, pipeline, key, labels, k, seed).select(key, *[F.col(label).alias(f"p_{label}") for label in labels])
    judged = F.inline(F.array(*[
        F.struct(F.lit(label).alias("dimension"), F.col(label).cast("int").alias("label"), (F.col(f"p_{label}") > 0.5).cast("int").alias("prediction"))
        for label in labels]))
    both = scored.join(rows.select(key, *labels), key).select(judged)
    return confusion_rates(both.where(F.col("label").isNotNull()), "dimension")


def fold_predictions(
    rows: DataFrame, pipeline: Pipeline, key: str, label: str, k: int = BLEND_FOLDS, seed: int = 1
) -> DataFrame:
    """(key, fold, probability): test-fold rows once, holdout rows once per model."""
    shared, fitted_part = shared_stages(pipeline)
    hashed = shared.transform(rows.select(key, "bow", label)).drop("bow", "words")
    models = fit_folds(hashed, fitted_part, key, label, k, seed)
    names = [f"p{i}" for i in range(k)]
    scored = with_probabilities(hashed, models, "p")
    fold = fold_of(key, label, k, seed)
    entries = F.array(*[F.struct(F.lit(i).alias("fold"), F.col(n).alias("probability")) for i, n in enumerate(names)])
    used = F.filter(entries, lambda e: F.col("own").isNull() | (e["fold"] == F.col("own")))
    return scored.withColumn("own", fold).select(key, F.inline(used))


def oof_target_mean(
    rows: DataFrame, key: str, label: str, bucket: str, k: int = BLEND_FOLDS, seed: int = 1
) -> DataFrame:
    """(key, blend): the blending scheme with a mean per bucket in place of a model.

    Sums per (bucket, fold) are taken once; leaving a fold out is a subtraction.
    """
    fold = fold_of(key, label, k, seed)
    sums = rows.where(F.col(label).isNotNull()).groupBy(bucket).agg(
        *[F.sum(F.when(fold == i, F.col(label))).alias(f"s{i}") for i in range(k)],
        *[F.count_if(fold == i).alias(f"n{i}") for i in range(k)],
    )
    total = lambda c: sum((F.coalesce(F.col(f"{c}{i}"), F.lit(0)) for i in range(k)), F.lit(0))
    left_out = [
        F.try_divide(total("s") - F.coalesce(F.col(f"s{i}"), F.lit(0)), total("n") - F.col(f"n{i}")) for i in range(k)
    ]
    means = sums.select(bucket, F.array(*left_out).alias("means"))
    known = F.filter("means", lambda m: m.isNotNull())
    average = F.try_divide(F.aggregate(known, F.lit(0.0), lambda s, m: s + m), F.size(known))
    value = F.when(fold.isNotNull(), F.get("means", fold)).otherwise(average)
    means = broadcast_if_small(cut_lineage(means))  # few buckets: rows need no shuffle by them
    return rows.join(means, bucket, "left").select(key, value.alias("blend"))


def dimension_models(
    rows: DataFrame, pipeline: Pipeline, key: str, labels: Sequence[str], parallelism: int = 5
) -> DataFrame:
    """(key, p_<label> per dimension): one model per label column, fitted side by side."""
    shared, fitted_part = shared_stages(pipeline)
    scored = shared.transform(rows.select(key, "bow", *labels)).drop("bow", "words")
    any_label = reduce(or_, [F.col(label).isNotNull() for label in labels])
    train = scored.where(any_label).persist()

    def fit(label: str) -> PipelineModel:
        rows_of = train.where(F.col(label).isNotNull())
        return fitted_part.fit(rows_of.withColumn("label", F.col(label).cast("double")))

    try:
        train.count()
        with ThreadPoolExecutor(parallelism) as pool:
            models = list(pool.map(fit, labels))
    finally:
        train.unpersist()
    for label, model in zip(labels, models):
        scored = with_probabilities(scored, [model], f"p_{label}_")
    return scored.select(key, *[F.col(f"p_{label}_0").alias(f"p_{label}") for label in labels])


def final_model(
    features: DataFrame, inputs: Sequence[str], key: str, label: str, k: int = 3, seed: int = 1, max_iter: int = 20
):
    """Boosted trees on blended features: (fitted model, mean accuracy over k folds)."""
    gbt = GBTClassifier(seed=seed, maxIter=max_iter)
    pipeline = Pipeline(stages=[VectorAssembler(inputCols=list(inputs), outputCol="features", handleInvalid="keep"), gbt])
    train = features.where(F.col(label).isNotNull()).withColumn("label", F.col(label).cast("double")).persist()
    try:
        scores = cv_scores(train, {"gbt": pipeline}, key, k, seed)
        return pipeline.fit(train), mean_scores(scores).first()["mean_accuracy"]
    finally:
        train.unpersist()
