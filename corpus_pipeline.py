"""From raw documents to token ids: select, deduplicate, mix and encode.

Each stage takes the documents that the stage before it kept, and all but the last return rows with
the columns of documents. Fitted models and counts are those of the stage's own input.

Defined cases, for all stages: an empty table gives no rows; null texts count as empty, null sources and ids
are values like any other; rows may repeat; further columns pass through, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinegrade.llm import chunked_bpe, exact_dedup, jaccard_join, mixing, ordinal
from cinegrade.llm.common import prepare, table, written

LEAST_TAIL = 0.75


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose top grade (good and not toxic) has a probability of LEAST_TAIL or more.

    All stay if no label, or every label, has that grade. Few labels give small weights, and tails near the
    share of the grade among them.
    """
    prepare(spark)
    model = ordinal.fit_ordinal(docs, ordinal.grades_of(table(spark, sf_dir, "labels")), grades=ordinal.GRADES)
    rows = docs.select(F.struct("*").alias("whole"), ordinal.tail_column(F.col("text"), model, ordinal.GRADES - 1).alias("tail"))
    return rows.where(F.col("tail") >= LEAST_TAIL).select("whole.*")


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id; a null id is smaller than any."""
    return exact_dedup.drop_copies(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 or more on five-word shingles.

    A document without words is linked with nothing and stays.
    """
    prepare(spark)
    return jaccard_join.drop_near_copies(docs, words_each=5, at_least=(4, 5))


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, and those of small sources again, up to twice, by temperature weights."""
    return mixing.mixed(docs, max_repeats=2.0)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each document of the mixture."""
    prepare(spark)
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ids = chunked_bpe.encode(docs, f.read(), public_tokenizers.PATTERN)
    return chunked_bpe.as_arrays(ids)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_duplicates),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources", source_mixture),
    ("byte-level BPE", token_ids),
]

#: SQL can express neither the fitted classifier nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's output is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
