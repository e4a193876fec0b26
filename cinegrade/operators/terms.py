"""Term statistics over documents with an array column of tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinegrade.functions.stem import stem_word
from cinegrade.functions.text import counted_terms
from cinegrade.session import broadcast_if_small, cut_lineage


def term_counts(docs: DataFrame, key: str, tokens: str = "tokens") -> DataFrame:
    """(key, term, n). Each document is counted inside its row: no shuffle at all."""
    return docs.select(key, F.inline(counted_terms(F.col(tokens))))


def doc_freq(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(term, df). Distinct tokens per row, then one map-side combined count."""
    terms = docs.select(F.explode(F.array_distinct(tokens)).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("df"))


def stem_vocabulary(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(term, stem, n) of every distinct token.

    The vocabulary is small next to the corpus, so adaptive execution would merge it into
    few partitions; it is spread again because stemming is bound by the processor.
    """
    terms = docs.select(F.explode(tokens).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    spread = terms.repartition(docs.sparkSession.sparkContext.defaultParallelism, "term")
    return spread.select("term", stem_word("term").alias("stem"), "n")


def idf(n_docs: int, df: Column, min_doc_freq: int) -> Column:
    """ln((N + 1) / (df + 1)), or 0 for a term in fewer than min_doc_freq documents."""
    weight = F.log((F.lit(float(n_docs)) + 1) / (df + 1))
    return F.when(df >= min_doc_freq, weight).otherwise(0.0)


def lookup(per_term: DataFrame) -> DataFrame:
    """A table of terms, written once and broadcast if its count allows.

    With a broadcast the exploded corpus does not shuffle for the join. A larger
    vocabulary shuffles, and AQE splits the frequent terms.
    """
    return broadcast_if_small(cut_lineage(per_term))


def tfidf(docs: DataFrame, key: str, tokens: str = "tokens", min_doc_freq: int = 2) -> DataFrame:
    """(key, term, n, df, tfidf)."""
    n_docs = docs.count()
    joined = term_counts(docs, key, tokens).join(lookup(doc_freq(docs, tokens)), "term")
    weight = F.col("n") * idf(n_docs, F.col("df"), min_doc_freq)
    return joined.select(key, "term", "n", "df", weight.alias("tfidf"))


def bounded_vocab(docs: DataFrame, tokens: str, min_df: float, max_df: float) -> DataFrame:
    """Terms whose share of the documents lies within [min_df, max_df]."""
    n_docs = docs.count()
    freq = doc_freq(docs, tokens)
    return freq.where(F.col("df").between(min_df * n_docs, max_df * n_docs))


def tfidf_unit(
    docs: DataFrame, key: str, tokens: str = "tokens", min_df: float = 0.01, max_df: float = 0.99
) -> DataFrame:
    """Smoothed TF-IDF n * (ln((1+N)/(1+df)) + 1), scaled to unit length per document.

    The vocabulary is bounded by min_df: at most mean-distinct-terms / min_df entries,
    however many documents there are.
    """
    n_docs = docs.count()
    vocab = lookup(bounded_vocab(docs, tokens, min_df, max_df))
    smooth = F.log(F.lit(1.0 + n_docs) / (1 + F.col("df"))) + 1
    weighed = (
        term_counts(docs, key, tokens)
        .join(vocab, "term")
        .select(key, "term", (F.col("n") * smooth).alias("weight"))
    )
    norm = F.sqrt(F.sum(F.col("weight") ** 2).over(Window.partitionBy(key)))
    return weighed.select(key, "term", (F.col("weight") / norm).alias("weight"))


def grouped_key_words(docs: DataFrame, group: str, n: int, tokens: str = "tokens") -> DataFrame:
    """(group, term, weight, rank): the n terms of each group with the largest weight against the rest.

    A term's weight is the share of the group's documents that use it, times the inverse document frequency
    ln((R + 1) / (r + 1)) over the R documents of all other groups, r of which use it. Frequencies combine on the map side;
    the best of a group are kept in each task before they meet.
    """
    sizes = docs.groupBy(group).agg(F.count("*").alias("n_in"))
    n_all = docs.count()
    used = docs.select(group, F.explode(F.array_distinct(tokens)).alias("term")).groupBy(group, "term").agg(F.count("*").alias("df_in"))
    used = cut_lineage(used)  # read twice below
    total = used.groupBy("term").agg(F.sum("df_in").alias("df"))
    rest = F.log((F.lit(n_all + 1.0) - F.col("n_in")) / (F.col("df") - F.col("df_in") + 1))
    weight = F.round(F.col("df_in") / F.col("n_in") * rest, 9).alias("weight")
    weighed = used.join(total, "term").join(sizes, group).select(group, "term", weight)
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("weight"), "term"))
    return weighed.withColumn("rank", rank).where(F.col("rank") <= n)


def term_moments(docs: DataFrame, key: str, tokens: str = "tokens", n_docs: int | None = None) -> DataFrame:
    """(term, df, mean, std) of each term's count over all documents, absent ones as 0.

    Built from sums, so that zeros are never materialised. The deviation is the sample's.
    """
    n = float(docs.count() if n_docs is None else n_docs)
    count = F.col("n").cast("double")
    sums = term_counts(docs, key, tokens).groupBy("term").agg(
        F.count("*").alias("df"), F.sum(count).alias("s1"), F.avg(count).alias("m1"), F.var_pop(count).alias("v1")
    )
    # squares about the mean: those among the present rows, and those of the step from 0 to their mean
    variance = F.col("df") * (F.col("v1") + F.col("m1") ** 2 * (1 - F.col("df") / n)) / (n - 1)
    return sums.select(
        "term", "df", (F.col("s1") / n).alias("mean"), F.sqrt(F.greatest(variance, F.lit(0.0))).alias("std")
    )


def standardise(docs: DataFrame, key: str, tokens: str = "tokens", min_doc_freq: int = 2) -> DataFrame:
    """(key, term, z, z_absent) of TF-IDF weights scaled to zero mean and unit deviation.

    z_absent is the value of every document without the term. Keeping it apart keeps the
    data sparse. A term's weight is its count times a constant, so mean and deviation
    follow from those of the counts: one table per term, and one join.
    """
    n_docs = docs.count()
    stats = term_moments(docs, key, tokens, n_docs).withColumn("idf", idf(n_docs, F.col("df"), min_doc_freq))
    spread = F.col("std") * F.col("idf")
    z = lambda x: F.when(spread > 0, (x - F.col("mean") * F.col("idf")) / spread).otherwise(0.0)
    return term_counts(docs, key, tokens).join(lookup(stats), "term").select(
        key, "term", z(F.col("n") * F.col("idf")).alias("z"), z(F.lit(0.0)).alias("z_absent")
    )


TEXT_PER_TASK = 16 << 20


def bigram_counts(docs: DataFrame, key: str, text: str, tokens: Callable[[Column], Column]) -> DataFrame:
    """(bigram, n). Nearly every other bigram is a new one, so what a task holds grows with its text: tasks follow the size of
    the table, TEXT_PER_TASK bytes of it for each. They count their own bigrams before these meet, so a frequent one is
    no hot spot, in as many tasks again.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // TEXT_PER_TASK))
    part = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("part")
    dealt = docs.select(part, text).repartitionById(parts, "part")
    pairs = dealt.select("part", F.explode(bigrams(tokens(F.col(text)))).alias("bigram"))
    counted = pairs.groupBy("part", "bigram").agg(F.count("*").alias("n"))
    return counted.select("bigram", "n").repartition(parts, "bigram").groupBy("bigram").agg(F.sum("n").alias("n"))


def bigrams(tokens: Column) -> Column:
    """Neighbouring token pairs, joined by a space."""

    def pairs(t: Column) -> Column:
        heads = F.slice(t, F.lit(1), F.greatest(F.size(t) - 1, F.lit(0)))
        return F.transform(heads, lambda w, i: F.concat_ws(" ", w, F.get(t, i + 1)))

    return F.flatten(F.transform(F.array(tokens), pairs))
