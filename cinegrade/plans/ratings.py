"""From parsed subtitles to rating predictions with spark.ml."""

from __future__ import annotations

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.feature import (
    IDF,
    HashingTF,
    NGram,
    StandardScaler,
    StopWordsRemover,
    StringIndexer,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinegrade.fixed_values import MIN_DOC_FREQ, NUM_FEATURES
from cinegrade.functions.labels import binary_rating, is_valid_rating
from cinegrade.functions.stem import stem_tokens
from cinegrade.functions.text import bag_of_words, remove_stop_words
from cinegrade.operators.joins import join_labels
from cinegrade.operators.network import SparseNetworkClassifier
from cinegrade.operators.scores import accuracy
from cinegrade.operators.splits import train_test_split
from cinegrade.sources.readers import subtitle_rows


def extract_labels(labels: DataFrame, binary: bool = True) -> DataFrame:
    """Labels with a valid rating, collapsed to R / NOT_R unless binary is off."""
    valid = labels.where(is_valid_rating(F.col("rating")))
    return valid.withColumn("rating", binary_rating(F.col("rating"))) if binary else valid


def stemmed_bags(subtitles: DataFrame) -> DataFrame:
    """Usable subtitles with `bow`, their stemmed tokens without stop words."""
    words = remove_stop_words(bag_of_words(F.col("sentences")))
    return subtitles.where(~F.col("corrupted")).withColumn("bow", stem_tokens(words))


def training_rows(files: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled bags (path, file_id, rating, bow) from raw files (path, xml).

    Labels join on the id inside the path first, so only labelled files are parsed.
    """
    labelled = join_labels(files, extract_labels(labels))
    return stemmed_bags(subtitle_rows(labelled, keep=["rating"])).select("path", "file_id", "rating", "bow")


def feature_stages(
    num_features: int = NUM_FEATURES,
    min_doc_freq: int = MIN_DOC_FREQ,
    feat: str = "tfidf",
    scale: bool = False,
    centre: bool = False,
    ngram: int = 1,
    tokens: str = "bow",
) -> list:
    """Stop words -> (n-grams ->) hashed counts -> (IDF ->) (scaling ->) `features`."""
    stages = [StopWordsRemover(inputCol=tokens, outputCol="words")]
    if ngram > 1:
        stages.append(NGram(n=ngram, inputCol="words", outputCol="grams"))
    last = "features" if feat == "tf" and not scale else "counts"
    stages.append(
        HashingTF(inputCol=stages[-1].getOutputCol(), outputCol=last, numFeatures=num_features)
    )
    if feat == "tfidf":
        last = "tfidf" if scale else "features"
        stages.append(IDF(inputCol="counts", outputCol=last, minDocFreq=min_doc_freq))
    if scale:
        stages.append(StandardScaler(inputCol=last, outputCol="features", withMean=centre, withStd=True))
    return stages


def classifier(model_type: str, seed: int = 1, **params):
    makers = {
        "naive_bayes": lambda: NaiveBayes(**params),
        "log_reg": lambda: LogisticRegression(**params),
        "gbt": lambda: GBTClassifier(seed=seed, **params),
        "rf": lambda: RandomForestClassifier(seed=seed, **params),
        "mlp": lambda: SparseNetworkClassifier(seed=seed, **{"maxIter": 100, "blockSize": 128, **params}),
    }
    return makers[model_type]()


def rating_pipeline(
    model_type: str, num_features: int = NUM_FEATURES, features: dict | None = None, **params
) -> Pipeline:
    """Token arrays in `bow` to predictions of `label`."""
    if model_type == "mlp":
        params.setdefault("layers", [num_features, 100, 2])
    stages = feature_stages(num_features, **(features or {}))
    return Pipeline(stages=[*stages, classifier(model_type, **params)])


def shared_stages(pipeline: Pipeline) -> tuple[PipelineModel, Pipeline]:
    """The leading stages that need no fitting, and the rest.

    When several models are fitted on the same rows, the first part is applied once.
    """
    stages = pipeline.getStages()
    first = next(i for i, stage in enumerate(stages) if isinstance(stage, Estimator))
    return PipelineModel(stages[:first]), Pipeline(stages=stages[first:])


def index_labels(rows: DataFrame, label: str = "rating") -> tuple[DataFrame, list[str]]:
    """Rows with a numeric `label` in alphabetic order of the rating, and the ratings."""
    model = StringIndexer(inputCol=label, outputCol="label", stringOrderType="alphabetAsc").fit(rows)
    return model.transform(rows), list(model.labels)


def probability(index: int = 1) -> Column:
    return vector_to_array(F.col("probability"))[index]


DENSE_BYTES = 1_300_000_000


def kept_for_fit(rows: DataFrame, num_features: int) -> DataFrame:
    """rows, kept. If a task would get more than DENSE_BYTES of them as rows of doubles, they are dealt to more tasks.

    Trees and networks hold each row with all its features, however few words it has.
    """
    kept = rows.persist()
    tasks = -(-kept.count() * 8 * num_features // DENSE_BYTES)
    if tasks <= kept.rdd.getNumPartitions():
        return kept
    dealt = kept.repartition(tasks).persist()
    dealt.count()
    kept.unpersist()
    return dealt


def fit_and_predict(rows: DataFrame, model_type: str, test_size: float = 0.2, seed: int = 1, key: str = "file_id", **options) -> tuple[PipelineModel, DataFrame]:
    """Fit on the training side and predict the test side.

    The training bags are kept because iterative fits read them many times.
    """
    train, test = train_test_split(rows, key, test_size, seed)
    train = kept_for_fit(train, options.get("num_features", NUM_FEATURES))
    try:
        model = rating_pipeline(model_type, **options).fit(train)
    finally:
        train.unpersist()
    return model, model.transform(test)


def holdout_accuracy(rows: DataFrame, model_type: str, **options) -> DataFrame:
    _, scored = fit_and_predict(rows, model_type, **options)
    return scored.agg(F.count("*").alias("n_test"), accuracy().alias("accuracy"))
