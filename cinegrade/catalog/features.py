"""Term weight, naive Bayes and vector queries."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.feature import HashingTF
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinegrade.catalog import tables as T
from cinegrade.catalog.guide import _reasons
from cinegrade.functions.text import clean_tokens, remove_stop_words
from cinegrade.operators import joins, terms
from cinegrade.operators import linkage
from cinegrade.operators import vectors as V
from cinegrade.operators.scores import accuracy, confusion_rates
from cinegrade.operators.splits import train_test_split
from cinegrade.plans import bayes, reasons
from cinegrade.plans.ratings import extract_labels
from cinegrade.sources import readers

CLASSES = ["NOT_R", "R"]
DIMENSIONS = ["quality", "toxic"]


def term_counts(spark, d):
    return terms.term_counts(T.tokenised(spark, d), "doc_id")


def doc_freq(spark, d):
    return terms.doc_freq(T.tokenised(spark, d))


def tfidf_terms(spark, d):
    weights = terms.tfidf(T.tokenised(spark, d), "doc_id", min_doc_freq=2)
    return weights.select("doc_id", "term", "n", "df", F.round("tfidf", 6).alias("tfidf"))


def feature_moments(spark, d):
    m = terms.term_moments(T.tokenised(spark, d), "doc_id")
    return m.select("term", F.round("mean", 9).alias("mean"), F.round("std", 6).alias("std"))


def standardise(spark, d):
    z = terms.standardise(T.tokenised(spark, d), "doc_id", min_doc_freq=2)
    return z.select("doc_id", "term", F.round("z", 4).alias("z"), F.round("z_absent", 4).alias("z_absent"))


def bounded_vocab(spark, d):
    return terms.bounded_vocab(_reasons(spark, d), "tokens", 0.01, 0.99)


def tfidf_l2(spark, d):
    weights = terms.tfidf_unit(_reasons(spark, d), "record_id", "tokens", 0.01, 0.99)
    return weights.select("record_id", "term", F.round("weight", 6).alias("weight"))


def key_words(spark, d):
    """The 50 most relevant words of the reasons."""
    best = reasons.key_words(_reasons(spark, d), 50)
    return best.select("term", F.round("weight", 6).alias("weight"))


def bigram_counts(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return terms.bigram_counts(docs, "doc_id", "text", lambda text: remove_stop_words(clean_tokens(text)))


def hashing_tf(spark, d):
    """Bucket counts per document: number of used buckets and of counted tokens."""
    hashed = HashingTF(inputCol="tokens", outputCol="tf", numFeatures=10000).transform(T.tokenised(spark, d))
    tf = F.unwrap_udt("tf")["values"]  # HashingTF gives sparse vectors: one value for each used bucket
    return hashed.select(
        "doc_id", F.size(tf).cast("long").alias("buckets"),
        F.aggregate(tf, F.lit(0.0), lambda s, x: s + x).cast("long").alias("tokens"),
    )


def _labelled(spark, d):
    labels = extract_labels(T.labels(spark, d)).withColumn("doc_id", F.col("file_id").cast("long"))
    return T.labelled_tokens(spark, d, labels)


def naive_bayes_params(spark, d):
    params = bayes.term_parameters(_labelled(spark, d), CLASSES, "rating", "tokens")
    return params.select("term", *[F.round(c, 9).alias(c) for c in CLASSES])


def naive_bayes_predict(spark, d):
    """Trained on the training side of the labelled documents, applied to all documents."""
    train, _ = train_test_split(_labelled(spark, d), "file_id")
    params = bayes.term_parameters(train, CLASSES, "rating", "tokens")
    prior = bayes.priors(train, CLASSES, "rating")
    scored = bayes.predict(T.tokenised(spark, d), params, prior, "doc_id", "tokens")
    return scored.select("doc_id", "prediction", *[F.round(c, 3).alias(c) for c in CLASSES])


def nb_holdout_accuracy(spark, d):
    """Accuracy on the held-out side of the labelled documents."""
    train, test = train_test_split(_labelled(spark, d), "file_id")
    params = bayes.term_parameters(train, CLASSES, "rating", "tokens")
    scored = bayes.predict(test, params, bayes.priors(train, CLASSES, "rating"), "doc_id", "tokens")
    judged = scored.join(test.select("doc_id", "rating"), "doc_id")
    return judged.agg(F.count("*").alias("n"), F.round(accuracy("rating", "prediction"), 9).alias("accuracy"))


def _out_of_fold(spark, d):
    return bayes.out_of_fold(_labelled(spark, d), CLASSES, "rating", "tokens", "doc_id", k=3)


def nb_fold_predictions(spark, d):
    """Each labelled document by the model of the other two folds."""
    scored = _out_of_fold(spark, d)
    return scored.select("doc_id", F.col("fold").cast("long").alias("fold"), "rating", "prediction", *[F.round(c, 3).alias(c) for c in CLASSES])


def nb_cv_scores(spark, d):
    """Accuracy of each of three folds, beside the mean of the folds."""
    folds = _out_of_fold(spark, d).groupBy("fold").agg(F.count("*").alias("n"), accuracy("rating", "prediction").alias("accuracy"))
    mean = F.avg("accuracy").over(Window.partitionBy(F.lit(0)))  # three rows
    return folds.select(
        F.col("fold").cast("long").alias("fold"), "n", F.round("accuracy", 9).alias("accuracy"), F.round(mean, 9).alias("mean_accuracy"))


def nb_dimension_scores(spark, d):
    """Accuracy, precision, false and true positive rate of each dimension, every document judged by the other folds."""
    labels, parts = T.table(spark, d, "labels"), []
    for dimension in DIMENSIONS:
        marked = labels.where(F.col(dimension).isNotNull()).select("doc_id", F.when(F.col(dimension) == 1, "yes").otherwise("no").alias("mark"))
        scored = bayes.out_of_fold(T.labelled_tokens(spark, d, marked), ["no", "yes"], "mark", "tokens", "doc_id", k=3)
        parts.append(scored.select(F.lit(dimension).alias("dimension"), *[(F.col(c) == "yes").cast("int").alias(a) for c, a in (("mark", "label"), ("prediction", "prediction"))]))
    rates = confusion_rates(reduce(DataFrame.unionByName, parts), "dimension")
    return rates.select("dimension", "tp", "fp", "tn", "fn", *[F.round(c, 9).alias(c) for c in ("accuracy", "precision", "fp_rate", "tp_rate")])


def _vectors(spark, d):
    """Embeddings as lines of a word-vector file, read back."""
    rows = T.table(spark, d, "embeddings")
    numbers = F.array_join(F.transform("embedding", lambda x: x.cast("double").cast("string")), " ")
    lines = rows.select(F.concat(F.lit("w"), F.col("vec_id").cast("string"), F.lit(" "), numbers).alias("value"))
    return readers.word_vector_rows(lines)


def word_vectors(spark, d):
    vectors = _vectors(spark, d).select("word", F.posexplode("vec").alias("pos", "x"))
    return vectors.select("word", F.col("pos").cast("long").alias("pos"), F.round("x", 9).alias("x"))


def vocab_vectors(spark, d):
    """Vocabulary w<doc_id> of the documents against the word vectors: found or missing."""
    vocab = T.table(spark, d, "documents").select(F.concat(F.lit("w"), F.col("doc_id").cast("string")).alias("word"))
    found = joins.vocab_vectors(vocab, _vectors(spark, d))
    return found.select("word", F.round(F.get("vec", 0), 9).alias("first"), F.col("vec").isNull().alias("missing"))


def cosine_pairs(spark, d):
    pairs = V.close_pairs(T.table(spark, d, "embeddings"), "vec_id", "embedding", 0.6)
    return pairs.select("a", "b", F.round("distance", 6).alias("distance"))


def vector_groups(spark, d):
    return V.vector_groups(T.table(spark, d, "embeddings"), "vec_id", "embedding", 0.6)


def complete_groups(spark, d):
    return linkage.complete_groups(T.table(spark, d, "embeddings"), "vec_id", "embedding", 0.6)


def probable_pairs(spark, d):
    """Close pairs by shared signs: at 0.6 the pairs are far apart, so many short bands."""
    pairs = V.probable_pairs(T.table(spark, d, "embeddings"), "vec_id", "embedding", 0.6, bits=4, bands=24)
    return pairs.select("a", "b", F.round("distance", 6).alias("distance"))


def pca_2d(spark, d):
    return V.planar(T.table(spark, d, "embeddings"), "vec_id", "embedding")


def kmeans_6(spark, d):
    return V.kmeans_groups(T.table(spark, d, "embeddings"), "vec_id", "embedding")


QUERIES = {
    f.__name__: f
    for f in (
        tfidf_terms, term_counts, doc_freq, feature_moments, standardise, bounded_vocab, tfidf_l2, key_words,
        bigram_counts, hashing_tf, naive_bayes_params, naive_bayes_predict,
        nb_holdout_accuracy, nb_fold_predictions, nb_cv_scores, nb_dimension_scores, word_vectors,
        vocab_vectors, cosine_pairs, vector_groups, complete_groups, probable_pairs, pca_2d, kmeans_6,
    )
}

_N = "(SELECT count(*) FROM documents)::DOUBLE"
_TFIDF = f"""
    t AS MATERIALIZED ({T.TERMS_SQL}), f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
    w AS MATERIALIZED (SELECT doc_id, term, n, df,
        n * CASE WHEN df >= 2 THEN ln(({_N} + 1) / (df + 1)) ELSE 0.0::DOUBLE END AS tfidf
        FROM t JOIN f USING (term))"""
_REASON_TERMS = """
    , x AS MATERIALIZED (SELECT record_id, term, count(*) AS n FROM (SELECT record_id, unnest(tokens) AS term FROM r) GROUP BY record_id, term),
    d AS (SELECT term, count(*) AS df FROM x GROUP BY term),
    v AS (SELECT term, df FROM d WHERE df BETWEEN 0.01::DOUBLE * (SELECT count(*) FROM r) AND 0.99::DOUBLE * (SELECT count(*) FROM r))"""


def _bayes(where: str) -> str:
    return f"""
    t AS MATERIALIZED ({T.TERMS_SQL}),
    l AS (SELECT doc_id, file_id, CASE WHEN rating = 'R' THEN 'R' ELSE 'NOT_R' END AS rating FROM ({T.VALID_SQL}) WHERE {where}),
    c AS (SELECT term, sum(CASE WHEN rating = 'R' THEN n ELSE 0 END) AS r, sum(CASE WHEN rating = 'R' THEN 0 ELSE n END) AS o
        FROM t JOIN l USING (doc_id) GROUP BY term),
    s AS (SELECT count(*) AS v, sum(r) AS r, sum(o) AS o FROM c),
    p AS (SELECT c.term, ln((c.r + 1)::DOUBLE / (s.r + s.v)) AS r, ln((c.o + 1)::DOUBLE / (s.o + s.v)) AS o FROM c, s)"""


def _folds(source: str, positive: str) -> str:
    return f"""
    t AS MATERIALIZED ({T.TERMS_SQL}),
    l AS MATERIALIZED (SELECT doc_id, CASE WHEN {positive} THEN 'R' ELSE 'NOT_R' END AS rating, {T.hash_sql('doc_id')} % 3 AS fold FROM {source}),
    f AS (SELECT unnest(range(3)) AS fold),
    c AS (SELECT f.fold, term, sum(CASE WHEN rating = 'R' THEN n ELSE 0 END) AS r, sum(CASE WHEN rating = 'R' THEN 0 ELSE n END) AS o
        FROM f JOIN l ON l.fold <> f.fold JOIN t USING (doc_id) GROUP BY f.fold, term),
    s AS (SELECT fold, count(*) AS v, sum(r) AS r, sum(o) AS o FROM c GROUP BY fold),
    p AS (SELECT fold, term, ln((c.r + 1)::DOUBLE / (s.r + s.v)) AS r, ln((c.o + 1)::DOUBLE / (s.o + s.v)) AS o FROM c JOIN s USING (fold)),
    k AS (SELECT f.fold, ln((count(*) FILTER (rating = 'R') + 1)::DOUBLE / (count(*) + 2)) AS r,
            ln((count(*) FILTER (rating <> 'R') + 1)::DOUBLE / (count(*) + 2)) AS o FROM f JOIN l ON l.fold <> f.fold GROUP BY f.fold),
    z AS (SELECT l.doc_id, sum(n * p.r) AS r, sum(n * p.o) AS o
        FROM l JOIN t USING (doc_id) JOIN p ON p.term = t.term AND p.fold = l.fold GROUP BY l.doc_id),
    q AS (SELECT l.doc_id, fold, rating, coalesce(z.r, 0) + k.r AS r, coalesce(z.o, 0) + k.o AS o
        FROM l JOIN k USING (fold) LEFT JOIN z USING (doc_id)),
    j AS (SELECT *, CASE WHEN o >= r THEN 'NOT_R' ELSE 'R' END AS prediction FROM q)"""


_FOLDS = _folds(f"({T.VALID_SQL})", "rating = 'R'")


def _dimension(name: str) -> str:
    return f"""
        WITH {_folds(f"(SELECT * FROM labels WHERE {name} IS NOT NULL)", f"{name} = 1")},
        n AS (SELECT count(*) FILTER (rating = 'R' AND prediction = 'R') AS tp, count(*) FILTER (rating <> 'R' AND prediction = 'R') AS fp,
                count(*) FILTER (rating <> 'R' AND prediction <> 'R') AS tn, count(*) FILTER (rating = 'R' AND prediction <> 'R') AS fn FROM j)
        SELECT '{name}' AS dimension, tp, fp, tn, fn, round((tp + tn)::DOUBLE / nullif(tp + fp + tn + fn, 0), 9) AS accuracy,
            round(tp::DOUBLE / nullif(tp + fp, 0), 9) AS "precision", round(fp::DOUBLE / nullif(fp + tn, 0), 9) AS fp_rate,
            round(tp::DOUBLE / nullif(tp + fn, 0), 9) AS tp_rate FROM n"""


_TRAIN = f"{T.hash_sql('doc_id', 1)} / 4294967296.0::DOUBLE >= 0.2"

from cinegrade.catalog.guide import _REASONS  # noqa: E402

ORACLES = {
    "tfidf_terms": f"WITH {_TFIDF} SELECT doc_id, term, n, df, round(tfidf, 6) AS tfidf FROM w",
    "term_counts": T.TERMS_SQL,
    "doc_freq": f"SELECT term, count(*) AS df FROM ({T.TERMS_SQL}) GROUP BY term",
    "feature_moments": f"""
        SELECT term, round(sum(n)::DOUBLE / {_N}, 9) AS mean,
            round(sqrt(greatest((sum(n * n) - sum(n)::DOUBLE * sum(n) / {_N}) / ({_N} - 1), 0)), 6) AS std
        FROM ({T.TERMS_SQL}) GROUP BY term""",
    "standardise": f"""
        WITH {_TFIDF},
        m AS (SELECT term, sum(tfidf) / {_N} AS mean,
                sqrt(greatest((sum(tfidf * tfidf) - sum(tfidf) * sum(tfidf) / {_N}) / ({_N} - 1), 0)) AS std
              FROM w GROUP BY term)
        SELECT doc_id, term, round(CASE WHEN std > 0 THEN (tfidf - mean) / std ELSE 0.0::DOUBLE END, 4) AS z,
            round(CASE WHEN std > 0 THEN (0 - mean) / std ELSE 0.0::DOUBLE END, 4) AS z_absent
        FROM w JOIN m USING (term)""",
    "bounded_vocab": f"{_REASONS} {_REASON_TERMS} SELECT term, df FROM v",
    "tfidf_l2": f"""{_REASONS} {_REASON_TERMS},
        y AS (SELECT record_id, term, n * (ln((1 + (SELECT count(*) FROM r))::DOUBLE / (1 + df)) + 1) AS w FROM x JOIN v USING (term))
        SELECT record_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY record_id)), 6) AS weight FROM y""",
    "key_words": f"""{_REASONS} {_REASON_TERMS},
        y AS (SELECT record_id, term, n * (ln((1 + (SELECT count(*) FROM r))::DOUBLE / (1 + df)) + 1) AS w FROM x JOIN v USING (term)),
        z AS (SELECT term, w / sqrt(sum(w * w) OVER (PARTITION BY record_id)) AS w FROM y)
        SELECT term, round(sum(w), 6) AS weight FROM z GROUP BY term ORDER BY sum(w) DESC, term LIMIT 50""",
    "bigram_counts": f"""
        SELECT bigram, count(*) AS n FROM (
            SELECT unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS bigram
            FROM (SELECT list_filter({T.TOKENS_SQL}, lambda w: w NOT IN {T.STOP_SQL}) AS t FROM documents))
        GROUP BY bigram""",
    "naive_bayes_params": f"""
        WITH {_bayes('true')} SELECT term, round(o, 9) AS "NOT_R", round(r, 9) AS "R" FROM p""",
    "naive_bayes_predict": f"""
        WITH {_bayes(_TRAIN)},
        k AS (SELECT ln((count(*) FILTER (rating = 'R') + 1)::DOUBLE / (count(*) + 2)) AS r,
                ln((count(*) FILTER (rating <> 'R') + 1)::DOUBLE / (count(*) + 2)) AS o FROM l),
        z AS (SELECT doc_id, sum(n * r) AS r, sum(n * o) AS o FROM t JOIN p USING (term) GROUP BY doc_id),
        q AS (SELECT d.doc_id, coalesce(z.r, 0) + k.r AS r, coalesce(z.o, 0) + k.o AS o
              FROM documents d LEFT JOIN z USING (doc_id), k)
        SELECT doc_id, CASE WHEN o >= r THEN 'NOT_R' ELSE 'R' END AS prediction, round(o, 3) AS "NOT_R", round(r, 3) AS "R" FROM q""",
    "nb_holdout_accuracy": f"""
        WITH {_bayes(_TRAIN)},
        k AS (SELECT ln((count(*) FILTER (rating = 'R') + 1)::DOUBLE / (count(*) + 2)) AS r,
                ln((count(*) FILTER (rating <> 'R') + 1)::DOUBLE / (count(*) + 2)) AS o FROM l),
        h AS (SELECT doc_id, CASE WHEN rating = 'R' THEN 'R' ELSE 'NOT_R' END AS rating FROM ({T.VALID_SQL}) WHERE NOT ({_TRAIN})),
        z AS (SELECT doc_id, sum(n * r) AS r, sum(n * o) AS o FROM t JOIN p USING (term) GROUP BY doc_id)
        SELECT count(*) AS n, round(avg(CASE WHEN (coalesce(z.o, 0) + k.o >= coalesce(z.r, 0) + k.r) = (rating = 'NOT_R') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS accuracy
        FROM h LEFT JOIN z USING (doc_id), k""",
    "nb_fold_predictions": f"""
        WITH {_FOLDS} SELECT doc_id, fold, rating, prediction, round(o, 3) AS "NOT_R", round(r, 3) AS "R" FROM j""",
    "nb_cv_scores": f"""
        WITH {_FOLDS},
        a AS (SELECT fold, count(*) AS n, avg(CASE WHEN rating = prediction THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS accuracy FROM j GROUP BY fold)
        SELECT fold, n, round(accuracy, 9) AS accuracy, round((SELECT avg(accuracy) FROM a), 9) AS mean_accuracy FROM a""",
    "nb_dimension_scores": " UNION ALL ".join(f"SELECT * FROM ({_dimension(name)})" for name in DIMENSIONS),
    "word_vectors": """
        SELECT 'w' || vec_id AS word, i - 1 AS pos, round(embedding[i]::DOUBLE, 9) AS x
        FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)""",
    "vocab_vectors": """
        SELECT 'w' || doc_id AS word, round(embedding[1]::DOUBLE, 9) AS "first", embedding IS NULL AS missing
        FROM documents LEFT JOIN embeddings ON vec_id = doc_id""",
    "cosine_pairs": """
        WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
        SELECT x.vec_id AS a, y.vec_id AS b, round(1 - list_cosine_similarity(x.e, y.e), 6) AS distance
        FROM v x JOIN v y ON x.vec_id < y.vec_id WHERE 1 - list_cosine_similarity(x.e, y.e) <= 0.6""",
    "vector_groups": """
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
        p AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id
            WHERE 1 - list_cosine_similarity(x.e, y.e) <= 0.6),
        reach AS (SELECT vec_id, vec_id AS root FROM embeddings
            UNION SELECT p.b, reach.root FROM reach JOIN p ON reach.vec_id = p.a)
        SELECT vec_id, min(root) AS "group" FROM reach GROUP BY vec_id""",
}
