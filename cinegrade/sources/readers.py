"""Readers for subtitles, labels, predictions, guide records and word vectors."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinegrade.functions import xml as X
from cinegrade.functions.text import file_id

FILMS_SCHEMA = "year INT, title STRING"
SUBTITLE_INDEX_SCHEMA = "MovieYear INT, MovieName STRING"
RATING_RECORDS_SCHEMA = "TITLE STRING, RATING STRING, REASON STRING, YEAR INT"


def label_rows(lines: DataFrame) -> DataFrame:
    """(file_id, rating) from CSV lines in column `value`; blank and header lines go."""
    kept = lines.where((F.col("value") != "") & ~F.contains("value", F.lit("IDSubtitle")))
    parsed = kept.select(F.from_csv("value", "file_id STRING, rating STRING").alias("row"))
    return parsed.select("row.*")


def read_labels(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """(file_id, rating) from CSV files. With `multi_line`, quoted fields may hold line breaks; a file is then one task."""
    if not multi_line:
        return label_rows(spark.read.text(path))
    table = spark.read.csv(path, schema="file_id STRING, rating STRING", quote='"', escape='"', multiLine=True)
    return table.where(F.col("file_id").isNull() | ~F.contains("file_id", F.lit("IDSubtitle")))


def prediction_rows(lines: DataFrame) -> DataFrame:
    """(file_id, category, prediction) from CSV lines id,sentiment,prediction."""
    schema = "IDSubtitle STRING, sentiment STRING, prediction STRING"
    kept = lines.where((F.col("value") != "") & ~F.contains("value", F.lit("IDSubtitle")))
    return _predictions(kept.select(F.from_csv("value", schema).alias("row")).select("row.*"))


def _predictions(table: DataFrame) -> DataFrame:
    return table.select(
        F.coalesce(F.col("IDSubtitle").try_cast("bigint"), F.col("IDSubtitle").try_cast("double").try_cast("bigint")).cast("string").alias("file_id"),
        F.col("sentiment").alias("category"),
        F.col("prediction").try_cast("double").alias("prediction"),
    )


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions from CSV files with a header: columns by name, in any order, beside any others.

    Quoted fields may hold line breaks.
    """
    table = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    return _predictions(table.where(F.col("IDSubtitle").isNotNull()))


def subtitle_rows(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Parsed subtitles: path, file_id, corrupted flag, reject text, sentences, metadata.

    `raw` holds path and xml; columns named in `keep` stay on the row.

    The parse sits in a one-row explode. Filters and projections above would otherwise be
    merged into it and parse each document several times.
    """
    doc = F.col("doc")
    parsed = F.explode(F.array(X.parse_subtitle(F.col("xml")))).alias("doc")
    return raw.select("path", *keep, parsed).select(
        "path",
        *keep,
        file_id(F.col("path")).alias("file_id"),
        X.is_corrupted(doc).alias("corrupted"),
        doc["_bad"].alias("reject"),
        X.sentence_rows(doc).alias("sentences"),
        X.metadata(doc).alias("meta"),
    )


def read_files(spark: SparkSession, path: str, file_ids: Sequence[str] | None = None) -> DataFrame:
    """(path, xml) of all files below `path`, one row per file.

    A file is one record, read whole; gzip files are opened by their suffix. `file_ids`
    narrows the read to single files, for a trial run.
    """
    whole = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    files = whole.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("xml"))
    return files if file_ids is None else files.where(file_id(F.col("path")).isin(list(file_ids)))


def read_subtitles(spark: SparkSession, path: str, file_ids: Sequence[str] | None = None) -> DataFrame:
    """All subtitle files below `path`, parsed; malformed ones are flagged."""
    return subtitle_rows(read_files(spark, path, file_ids))


def read_subtitle_records(spark: SparkSession, path: str) -> DataFrame:
    """Subtitles from files that hold many `document` elements. A file is read in one task, so large ones are better cut before."""
    docs = (
        spark.read.format("xml")
        .options(rowTag="document", **X.XML_OPTIONS)
        .schema(X.SUBTITLE_SCHEMA)
        .option("recursiveFileLookup", True)
        .load(path)
    )
    doc = F.struct("meta", "s", "_bad")
    return docs.select(F.col("_metadata.file_path").alias("path"), doc.alias("doc")).select(
        "path",
        X.is_corrupted(F.col("doc")).alias("corrupted"),
        F.col("doc._bad").alias("reject"),
        X.sentence_rows(F.col("doc"), "txt").alias("sentences"),
        X.metadata(F.col("doc")).alias("meta"),
    )


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Path, size and id of every file below `path`; contents stay unread.

    Spark's file sources pass over files of zero bytes, this one too. Compare the ids with
    those of the labels to find them.
    """
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(path)
        .select("path", "length", file_id(F.col("path")).alias("file_id"))
    )


def read_table(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """CSV table with a header line and a fixed schema.

    Bytes that are no UTF-8 are dropped. Quoted fields may hold line breaks; without `multi_line`
    they may not, and large files are split.
    """
    table = spark.read.csv(path, header=True, schema=schema, quote='"', escape='"', multiLine=multi_line)
    strings = {name for name, kind in table.dtypes if kind == "string"}
    return table.select(*[
        F.replace(name, F.lit("\ufffd"), F.lit("")).alias(name) if name in strings else F.col(name) for name in table.columns
    ])


def word_vector_rows(lines: DataFrame) -> DataFrame:
    """(word, vec) from lines `word v1 v2 ..` in column `value`; what is no number is a null element."""
    parts = F.split(F.trim("value"), " +")
    return lines.where(F.trim("value") != "").select(
        parts[0].alias("word"),
        F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda x: x.try_cast("double")).alias("vec"),
    )


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    return word_vector_rows(spark.read.text(path))


def find_guides(records: DataFrame, sections: Sequence[str], key: str = "imdb_id") -> DataFrame:
    """Records with at least one section; only the key and the sections are kept."""
    present = [F.col(name).isNotNull() for name in sections]
    return records.where(reduce(or_, present)).select(key, *sections)
