"""Label joins, holdout rows, lookups and wide frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinegrade.functions.text import file_id
from cinegrade.session import broadcast_if_small


def join_labels(files: DataFrame, labels: DataFrame, path: str = "path") -> DataFrame:
    """Files with a label; the label key is the file id within the path."""
    return files.withColumn("file_id", file_id(F.col(path))).join(labels, "file_id")


def lookup_labels(files: DataFrame, labels: DataFrame, path: str = "path", max_rows: int = 1_000_000) -> DataFrame:
    """The same join as a map-side lookup, as long as the labels are few enough."""
    return join_labels(files, broadcast_if_small(labels, max_rows), path)


def labelled_paths(files: DataFrame, labels: DataFrame, path: str = "path") -> DataFrame:
    """Distinct (rating, path) of labelled files."""
    return join_labels(files, labels, path).select("rating", path).distinct()


def first_labelled(files: DataFrame, labels: DataFrame, n: int, path: str = "path") -> DataFrame:
    """The n labelled files with the smallest ids, as a top-n without a full sort."""
    return join_labels(files, labels, path).orderBy("file_id", path).limit(n)


def train_and_holdout(
    docs: DataFrame, predictions: DataFrame, key: str = "path"
) -> tuple[DataFrame, DataFrame]:
    """Documents with a prediction for one category, and all others."""
    keyed = docs.withColumn("file_id", file_id(F.col(key)))
    return keyed.join(predictions, "file_id"), keyed.join(predictions, "file_id", "left_anti")


def average_scores(scores: DataFrame, key: str, score: str = "score") -> DataFrame:
    """Mean score per key over the models that gave one."""
    return scores.groupBy(key).agg(F.avg(score).alias(score))


def widen(scores: DataFrame, key: str, names: Sequence[str], name_col: str = "category", score: str = "score") -> DataFrame:
    """One row per key with a column per category."""
    return scores.groupBy(key).agg(
        *[F.max(F.when(F.col(name_col) == n, F.col(score))).alias(n) for n in names]
    )


def vocab_vectors(vocab: DataFrame, vectors: DataFrame, word: str = "word") -> DataFrame:
    """Vectors of the vocabulary; a word without one keeps its row with a null vector."""
    return vocab.join(vectors, word, "left")


def merge_titles(
    targets: DataFrame,
    subtitles: DataFrame,
    films: DataFrame,
    name: str = "MovieName",
    film: str = "film",
    year: str | None = "year",
) -> DataFrame:
    """Left joins of the targets to subtitles on `name` and to films on `film`.

    Targets without a match carry '' and join nothing. With `year` the joined rows also
    agree on that column; without it equal titles of all years multiply. Give the tables
    distinct names for their other columns: Spark does not tell TITLE from title.
    """
    shared = [] if year is None else [year]
    named = subtitles.where(F.col(name) != "")
    titled = films.where(F.col(film) != "")
    return targets.join(named, [name, *shared], "left").join(titled, [film, *shared], "left")
