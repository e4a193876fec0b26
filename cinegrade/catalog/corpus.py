"""Corpus queries: label and subtitle sources, extraction, tokens."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from cinegrade.catalog import tables as T
from cinegrade.catalog.stem_sql import stem_sql
from cinegrade.fixed_values import RARE_RATINGS
from cinegrade.functions import text as X
from cinegrade.functions import xml
from cinegrade.functions.labels import binary_rating, current_rating, is_valid_rating
from cinegrade.operators import joins, scores
from cinegrade.operators.terms import stem_vocabulary as stem_vocabulary_of
from cinegrade.plans import ratings
from cinegrade.session import scratch_path
from cinegrade.sources import readers, writers


def load_labels(spark, d):
    lines = T.labels(spark, d).select(F.concat_ws(",", "file_id", "rating", F.lit('"a, b"')).alias("value"))
    head = lines.limit(1).select(F.explode(F.array(F.lit("IDSubtitle,RATING,NOTE"), F.lit(""))).alias("value"))
    return readers.label_rows(head.union(lines))


def load_category_predictions(spark, d):
    rows = T.table(spark, d, "labels").unpivot("doc_id", ["quality", "toxic"], "category", "prediction")
    lines = rows.select(F.concat_ws(",", F.concat("doc_id", F.lit(".0")), "category", "prediction").alias("value"))
    return readers.prediction_rows(lines)


def xml_scan(spark, d):
    subs = T.subtitles(spark, d)
    return subs.select(
        "path", "file_id", "corrupted",
        F.col("reject").isNotNull().alias("malformed"),
        F.size("sentences").cast("long").alias("n_sentences"),
        F.array_join(X.raw_words(F.col("sentences")), "|").alias("words"),
    )


XML_FILE_BYTES = 32 << 20


def _in_elements(lines, most=XML_FILE_BYTES):
    """The whole documents of each batch inside root elements of about `most` bytes, each one a file's content."""
    for batch in lines:
        docs = batch.column("value").filter(pc.ends_with(batch.column("value"), "</document>"))
        if len(docs):
            ends = np.cumsum(pc.binary_length(docs).to_numpy())
            cuts = np.flatnonzero(np.diff((ends - 1) // most)) + 1
            for first, end in itertools.pairwise([0, *cuts, len(docs)]):
                content = "\n".join(["<all>", *docs[first:end].to_pylist(), "</all>"])
                yield pa.RecordBatch.from_arrays([pa.array([content])], names=["value"])


def xml_records(spark, d):
    """Documents written together as large XML files and read back record by record.

    Spark reads such a file in one task, so the files are bounded. The malformed documents of src13 stay out: without
    their end a record would run into the next.
    """
    lines = T.subtitle_xml(spark, d).select(F.replace("xml", F.lit("<source>"), F.concat(F.lit("<source><path>"), F.col("path"), F.lit("</path>"))).alias("value"))
    folder = scratch_path(spark, "xml-records")
    lines.mapInArrow(_in_elements, "value string").write.option("maxRecordsPerFile", 1).text(folder)
    records = readers.read_subtitle_records(spark, folder)
    return records.select(
        F.col("meta")["path"].alias("path"), "corrupted", F.col("reject").isNotNull().alias("malformed"),
        F.size("sentences").cast("long").alias("n_sentences"), F.array_join(X.raw_words(F.col("sentences")), "|").alias("words"))


def labelled_paths(spark, d):
    return joins.labelled_paths(T.documents(spark, d).select("path"), T.labels(spark, d))


def limited_scan(spark, d):
    files = T.documents(spark, d).select("path")
    return joins.first_labelled(files, T.labels(spark, d), 100).select("file_id", "path", "rating")


def checkpoint_roundtrip(spark, d):
    docs = T.tokenised(spark, d)
    saved = writers.save(docs, scratch_path(spark, "bags"))
    return saved.select(
        "doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens")
    )


def file_id_from_path(spark, d):
    pages = T.table(spark, d, "pages")
    return pages.select("page_id", X.file_id(F.col("url")).alias("file_id")).union(
        T.documents(spark, d).select("doc_id", X.file_id(F.col("path")))
    )


def valid_ratings(spark, d):
    return T.labels(spark, d).where(is_valid_rating(F.col("rating")))


def binary_label(spark, d):
    return valid_ratings(spark, d).select("file_id", binary_rating(F.col("rating")).alias("rating"))


def merge_ratings(spark, d):
    merged = T.labels(spark, d).withColumn("rating", current_rating(F.col("rating")))
    return merged.where(~F.col("rating").isin(RARE_RATINGS))


def sentence_rows(spark, d):
    subs = T.subtitles(spark, d).where("NOT corrupted")
    rows = subs.select("file_id", F.posexplode("sentences").alias("pos", "s"))
    return rows.select(
        "file_id", F.col("pos").cast("long").alias("pos"), F.col("s.id").alias("sentence_id"),
        F.array_join("s.times", "|").alias("times"), F.array_join("s.words", "|").alias("words"),
    )


def drop_corrupted(spark, d):
    return T.subtitles(spark, d).where("NOT corrupted").select("file_id", "path")


def doc_meta(spark, d):
    subs = T.subtitles(spark, d).where("NOT corrupted")
    return subs.select("file_id", F.explode("meta").alias("field", "value"))


def doc_meta_features(spark, d):
    subs = T.subtitles(spark, d).where("NOT corrupted")
    return subs.select(
        "file_id",
        xml.duration_seconds(F.col("sentences")).alias("duration"),
        F.size(X.bag_of_words(F.col("sentences"))).cast("long").alias("n_tokens"),
        F.try_element_at("meta", F.lit("genre")).alias("genre"),
    )


def percent_parsed(spark, d):
    parsed = scores.percent_parsed(T.subtitles(spark, d))
    return parsed.select(F.round("percent_parsed", 6).alias("percent_parsed"))


def clean_tokens(spark, d):
    docs = T.tokenised(spark, d, stop_words=False)
    return docs.select("doc_id", F.posexplode("tokens").alias("pos", "token")).select(
        "doc_id", F.col("pos").cast("long").alias("pos"), "token"
    )


def bag_of_words(spark, d):
    subs = T.subtitles(spark, d).where("NOT corrupted")
    return subs.select("file_id", F.array_join(X.bag_of_words(F.col("sentences")), " ").alias("bow"))


def raw_words(spark, d):
    subs = T.subtitles(spark, d).where("NOT corrupted")
    words = X.raw_words(F.col("sentences"))
    return subs.select("file_id", F.size(words).cast("long").alias("n_words"), F.array_join(words, " ").alias("words"))


def remove_stopwords(spark, d):
    docs = T.tokenised(spark, d)
    return docs.select("doc_id", F.array_join("tokens", " ").alias("tokens"))


def stem_vocabulary(spark, d):
    return stem_vocabulary_of(T.tokenised(spark, d), "tokens")


def stemmed_bags(spark, d):
    """XML -> bag -> stop words -> stems of every usable subtitle."""
    bags = ratings.stemmed_bags(T.subtitles(spark, d))
    return bags.select("file_id", F.array_join("bow", " ").alias("bow"))


def labelled_bags(spark, d):
    """The rows that rating models are fitted on: stemmed bags of labelled subtitles."""
    rows = ratings.training_rows(T.subtitle_xml(spark, d), T.labels(spark, d))
    return rows.select("path", "file_id", "rating", F.array_join("bow", " ").alias("bow"))


def normalise_title(spark, d):
    text = F.col("text")
    return T.table(spark, d, "documents").select(
        "doc_id", X.strip_title(text).alias("title"), X.dated_title(text).alias("dated_title")
    )


def craft_key(spark, d):
    pages = T.table(spark, d, "pages")
    return pages.select("page_id", X.craft_key(F.col("url")).alias("url_key"), X.craft_key(F.col("html")).alias("html_key"))


def unique_ratings(spark, d):
    return scores.distinct_sorted(T.labels(spark, d), "rating")


QUERIES = {
    f.__name__: f
    for f in (
        load_labels, load_category_predictions, xml_scan, xml_records, labelled_paths, limited_scan,
        checkpoint_roundtrip, file_id_from_path, valid_ratings, binary_label, merge_ratings,
        sentence_rows, drop_corrupted, doc_meta, doc_meta_features, percent_parsed, clean_tokens,
        bag_of_words, raw_words, remove_stopwords, stem_vocabulary, stemmed_bags, labelled_bags, normalise_title,
        craft_key, unique_ratings,
    )
}

_USABLE = "source NOT IN ('src7', 'src13')"
_FILE_ID = r"split_part(list_extract(string_split({0}, '/'), -1), '.', 1)"

_STEMMED = f"""
    m AS MATERIALIZED ({stem_sql(f"SELECT DISTINCT term, 1 AS n FROM ({T.TERMS_SQL})")}),
    k AS (SELECT doc_id, list_filter({T.TOKENS_SQL}, lambda w: w NOT IN {T.STOP_SQL}) AS t FROM documents WHERE {_USABLE}),
    b AS (SELECT doc_id, string_agg(stem, ' ' ORDER BY i) AS bow
        FROM (SELECT doc_id, t[i] AS term, i FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM k)) JOIN m USING (term)
        GROUP BY doc_id)"""

ORACLES = {
    "load_labels": f"SELECT file_id, rating FROM ({T.LABELS_SQL})",
    "load_category_predictions": """
        SELECT CAST(doc_id AS VARCHAR) AS file_id, 'quality' AS category, CAST(quality AS DOUBLE) AS prediction FROM labels
        UNION ALL SELECT CAST(doc_id AS VARCHAR), 'toxic', CAST(toxic AS DOUBLE) FROM labels""",
    "xml_scan": f"""
        SELECT {T.PATH_SQL} AS path, CAST(doc_id AS VARCHAR) AS file_id, NOT ({_USABLE}) AS corrupted,
            source = 'src13' AS malformed,
            CASE WHEN {_USABLE} THEN len(string_split(text, chr(10))) ELSE 0 END AS n_sentences,
            CASE WHEN {_USABLE} THEN array_to_string({T.WORDS_SQL}, '|') ELSE '' END AS words
        FROM documents""",
    "xml_records": f"""
        SELECT {T.PATH_SQL} AS path, source = 'src7' AS corrupted, false AS malformed,
            CASE WHEN {_USABLE} THEN len(string_split(text, chr(10))) ELSE 0 END AS n_sentences,
            CASE WHEN {_USABLE} THEN array_to_string({T.WORDS_SQL}, '|') ELSE '' END AS words
        FROM documents WHERE source <> 'src13'""",
    "labelled_paths": f"""
        SELECT DISTINCT rating, {T.PATH_SQL} AS path
        FROM documents JOIN ({T.LABELS_SQL}) l USING (doc_id)""",
    "limited_scan": f"""
        SELECT file_id, {T.PATH_SQL} AS path, rating
        FROM documents JOIN ({T.LABELS_SQL}) l USING (doc_id) ORDER BY file_id, path LIMIT 100""",
    "checkpoint_roundtrip": f"""
        SELECT doc_id, len(t) AS n_tokens, array_to_string(t, ' ') AS tokens
        FROM (SELECT doc_id, list_filter({T.TOKENS_SQL}, lambda w: w NOT IN {T.STOP_SQL}) AS t FROM documents)""",
    "file_id_from_path": f"""
        SELECT page_id, {_FILE_ID.format('url')} AS file_id FROM pages
        UNION ALL SELECT doc_id, CAST(doc_id AS VARCHAR) FROM documents""",
    "valid_ratings": f"SELECT file_id, rating FROM ({T.VALID_SQL})",
    "binary_label": f"""
        SELECT file_id, CASE WHEN rating = 'R' THEN 'R' ELSE 'NOT_R' END AS rating FROM ({T.VALID_SQL})""",
    "merge_ratings": f"""
        SELECT file_id, CASE WHEN rating IN ('GP', 'M', 'M/PG') THEN 'PG' ELSE rating END AS rating
        FROM ({T.LABELS_SQL}) WHERE rating NOT IN ('NC-17', 'X')""",
    "sentence_rows": f"""
        SELECT file_id, i - 1 AS pos, CAST(i AS VARCHAR) AS sentence_id,
            printf('%02d:%02d:%02d,000', 2 * (i - 1) // 3600, 2 * (i - 1) // 60 % 60, 2 * (i - 1) % 60) AS times,
            array_to_string(list_filter(string_split(lines[i], ' '), lambda w: w <> ''), '|') AS words
        FROM (SELECT CAST(doc_id AS VARCHAR) AS file_id, string_split(text, chr(10)) AS lines,
                unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i
              FROM documents WHERE {_USABLE})""",
    "drop_corrupted": f"SELECT CAST(doc_id AS VARCHAR) AS file_id, {T.PATH_SQL} AS path FROM documents WHERE {_USABLE}",
    "doc_meta": f"""
        WITH u AS (SELECT CAST(doc_id AS VARCHAR) AS file_id, * FROM documents WHERE {_USABLE})
        SELECT file_id, 'genre' AS field, lang AS value FROM u
        UNION ALL SELECT file_id, 'title', source FROM u
        UNION ALL SELECT file_id, 'sentences', CAST(len(string_split(text, chr(10))) AS VARCHAR) FROM u
        UNION ALL SELECT file_id, 'tokens', CAST(len({T.WORDS_SQL}) AS VARCHAR) FROM u""",
    "doc_meta_features": f"""
        SELECT CAST(doc_id AS VARCHAR) AS file_id,
            CAST(2 * (len(string_split(text, chr(10))) - 1) AS DOUBLE) AS duration,
            len({T.TOKENS_SQL}) AS n_tokens, lang AS genre
        FROM documents WHERE {_USABLE}""",
    "percent_parsed": f"""
        SELECT round(100.0::DOUBLE * count(*) FILTER ({_USABLE}) / count(*), 6) AS percent_parsed FROM documents""",
    "clean_tokens": f"""
        SELECT doc_id, i - 1 AS pos, t[i] AS token
        FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i
              FROM (SELECT doc_id, {T.TOKENS_SQL} AS t FROM documents))""",
    "bag_of_words": f"""
        SELECT CAST(doc_id AS VARCHAR) AS file_id, array_to_string({T.TOKENS_SQL}, ' ') AS bow
        FROM documents WHERE {_USABLE}""",
    "raw_words": f"""
        SELECT CAST(doc_id AS VARCHAR) AS file_id, len({T.WORDS_SQL}) AS n_words,
            array_to_string({T.WORDS_SQL}, ' ') AS words
        FROM documents WHERE {_USABLE}""",
    "remove_stopwords": f"""
        SELECT doc_id, array_to_string(list_filter({T.TOKENS_SQL}, lambda w: w NOT IN {T.STOP_SQL}), ' ') AS tokens
        FROM documents""",
    "stem_vocabulary": stem_sql(f"SELECT term, CAST(sum(n) AS BIGINT) AS n FROM ({T.TERMS_SQL}) GROUP BY term"),
    "stemmed_bags": f"""
        WITH {_STEMMED}
        SELECT CAST(doc_id AS VARCHAR) AS file_id, coalesce(bow, '') AS bow FROM k LEFT JOIN b USING (doc_id)""",
    "labelled_bags": f"""
        WITH {_STEMMED}
        SELECT {T.PATH_SQL} AS path, file_id, CASE WHEN rating = 'R' THEN 'R' ELSE 'NOT_R' END AS rating, coalesce(bow, '') AS bow
        FROM documents JOIN ({T.VALID_SQL}) v USING (doc_id) JOIN k USING (doc_id) LEFT JOIN b USING (doc_id)""",
    "normalise_title": r"""
        SELECT doc_id, regexp_replace(lower(text), '\p{P}+', '', 'g') AS title,
            regexp_replace(lower(trim(left(text, greatest(length(text) - 6, 0)), chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))),
                '\p{P}+', '', 'g') AS dated_title
        FROM documents""",
    "craft_key": r"""
        SELECT page_id, lower(array_to_string(regexp_extract_all(url, '\w+'), '_')) AS url_key,
            lower(array_to_string(regexp_extract_all(html, '\w+'), '_')) AS html_key
        FROM pages""",
    "unique_ratings": f"SELECT DISTINCT rating FROM ({T.LABELS_SQL}) ORDER BY rating",
}
