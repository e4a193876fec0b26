"""Model queries: fits, comparison, blending, comment vectors, stream scoring.

All sizes are the library's defaults. The layouts of `layer_search` have up to 25 million weights; use a
small table for it on one machine.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cinegrade.catalog import tables as T
from cinegrade.catalog.guide import _comments, comment_targets
from cinegrade.fixed_values import NUM_FEATURES, SEARCH_MIN_DOC_FREQ
from cinegrade.functions.text import clean_tokens, remove_stop_words
from cinegrade.plans import blend, docvectors, factors, guide, ratings, search
from cinegrade.session import scratch_path, written
from cinegrade.sources import writers
from cinegrade.sources.readers import subtitle_rows
from cinegrade.streaming.score import arriving, score_stream

FEATURES = NUM_FEATURES


def _rows(spark, d):
    """Labelled documents: doc_id, file_id, bow, rating, label (0 NOT_R, 1 R)."""
    labels = ratings.extract_labels(T.labels(spark, d)).withColumn("doc_id", F.col("file_id").cast("long"))
    rows = T.labelled_tokens(spark, d, labels).withColumnRenamed("tokens", "bow")
    return rows.withColumn("label", (F.col("rating") == "R").cast("double"))


def _all_rows(spark, d):
    """All documents with their nullable quality and toxic labels; the join comes first, so who wants labelled ones tokenises no others."""
    docs = T.table(spark, d, "documents").select("doc_id", "text").join(T.table(spark, d, "labels"), "doc_id", "left")
    return docs.withColumn("bow", remove_stop_words(clean_tokens(F.col("text")))).drop("text")


def rating_fit(spark, d):
    """Naive Bayes on the stemmed bags of labelled subtitles, applied to every usable subtitle.

    All bags are wanted, so each subtitle is parsed and stemmed once, and the fit reads written bags.
    """
    bags = written(ratings.stemmed_bags(subtitle_rows(T.subtitle_xml(spark, d))).select("file_id", "bow"), "bags")
    train = bags.join(ratings.extract_labels(T.labels(spark, d)), "file_id").withColumn("label", (F.col("rating") == "R").cast("double"))
    model = ratings.rating_pipeline("naive_bayes", FEATURES).fit(train)
    return model.transform(bags).select("file_id", "prediction", ratings.probability(1).alias("probability"))


def _predict(spark, d, model_type, **params):
    _, scored = ratings.fit_and_predict(_rows(spark, d), model_type, num_features=FEATURES, **params)
    return scored.select("doc_id", "label", "prediction", ratings.probability(1).alias("probability"))


def logreg_predict(spark, d):
    return _predict(spark, d, "log_reg", features={"scale": True})


def gbt_predict(spark, d):
    return _predict(spark, d, "gbt")


def rf_predict(spark, d):
    return _predict(spark, d, "rf")


def mlp_predict(spark, d):
    return _predict(spark, d, "mlp")


def holdout_accuracy(spark, d):
    return ratings.holdout_accuracy(_rows(spark, d), "naive_bayes", num_features=FEATURES)


def cv_scores(spark, d):
    models = ("naive_bayes", "log_reg", "gbt", "rf", "mlp")
    pipelines = {m: ratings.rating_pipeline(m, FEATURES, {"min_doc_freq": SEARCH_MIN_DOC_FREQ}) for m in models}
    return search.cv_scores(_rows(spark, d), pipelines, "doc_id")


def layer_search(spark, d):
    return search.layer_search(_rows(spark, d), "doc_id")


def _blend_pipeline():
    return ratings.rating_pipeline("log_reg", FEATURES, {"min_doc_freq": 0})


def fold_predictions(spark, d):
    return blend.fold_predictions(_all_rows(spark, d), _blend_pipeline(), "doc_id", "toxic")


def blend_features(spark, d):
    return blend.blend_all(_all_rows(spark, d), _blend_pipeline(), "doc_id", ["toxic"])


def blend_all(spark, d):
    return blend.blend_all(_all_rows(spark, d), _blend_pipeline(), "doc_id", ["quality", "toxic"])


def oof_target_mean(spark, d):
    docs = T.table(spark, d, "documents").select("doc_id", "n_chars")
    rows = docs.join(T.table(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "left")
    rows = rows.withColumn("bucket", F.length(F.bin("n_chars")))
    mean = blend.oof_target_mean(rows, "doc_id", "toxic", "bucket")
    return mean.select("doc_id", F.round("blend", 9).alias("blend"))


def dimension_models(spark, d):
    return blend.dimension_models(_all_rows(spark, d), _blend_pipeline(), "doc_id", ["quality", "toxic"])


def dimension_scores(spark, d):
    """Accuracy, precision and rates of the logistic model of each dimension, out of fold."""
    return blend.dimension_scores(_all_rows(spark, d), _blend_pipeline(), "doc_id", ["quality", "toxic"])


def final_gbt(spark, d):
    """Boosted trees on the blended features, against the binary rating of labelled rows."""
    blended = writers.save(blend_all(spark, d), scratch_path(spark, "blended"))
    rated = T.table(spark, d, "labels").select("doc_id", F.col("toxic").alias("rated_r"))
    features = blended.join(rated, "doc_id", "left")
    model, score = blend.final_model(features, ["quality", "toxic"], "doc_id", "rated_r")
    scored = model.transform(features).select("doc_id", "prediction", ratings.probability(1).alias("probability"))
    return scored.withColumn("cv_accuracy", F.lit(score))


def _comment_vectors(spark, d):
    corpus = guide.training_corpus(_comments(spark, d))
    return docvectors.skip_gram_vectors(corpus)


def doc_vectors(spark, d):
    vector = vector_to_array("doc_vector")
    return _comment_vectors(spark, d).select("sentence_tag", "category", F.array_join(vector.cast("array<string>"), " ").alias("doc_vector"))


def factor_vectors(spark, d):
    """Vectors of all comments from a factorised table of (comment, word), as text."""
    vectors = factors.doc_factors(guide.training_corpus(_comments(spark, d)))
    return vectors.select("sentence_tag", "category", F.array_join(F.col("doc_vector").cast("array<string>"), " ").alias("doc_vector"))


def comment_sentiment(spark, d):
    """Comments with a weak label (comment_targets) teach; the rest is predicted."""
    vectors = _comment_vectors(spark, d).select("imdb_id", "category", "doc_vector")
    labels = comment_targets(spark, d).where("label IS NOT NULL").select("imdb_id", "category", "label")
    return docvectors.comment_sentiment(vectors, labels, ["imdb_id", "category"])


def _prepared(docs):
    return docs.select("doc_id", remove_stop_words(clean_tokens(F.col("text"))).alias("bow"))


def stream_score(spark, d):
    """All documents as a stream, scored with a fitted model and read back from the sink."""
    model = ratings.rating_pipeline("naive_bayes", FEATURES).fit(_rows(spark, d))
    schema = spark.read.parquet(f"{d}/documents.parquet").schema
    out = scratch_path(spark, "scored")
    query = score_stream(
        arriving(spark, d, schema, "documents.parquet"), _prepared, model,
        ["doc_id", "prediction", ratings.probability(1).alias("probability")],
        out, scratch_path(spark, "scored-checkpoint"),
    )
    query.awaitTermination()
    return spark.read.schema("doc_id BIGINT, prediction DOUBLE, probability DOUBLE").parquet(out)


QUERIES = {
    f.__name__: f
    for f in (
        rating_fit, logreg_predict, gbt_predict, rf_predict, mlp_predict, holdout_accuracy, cv_scores,
        layer_search, fold_predictions, blend_features, blend_all, oof_target_mean, dimension_models, dimension_scores,
        final_gbt, doc_vectors, factor_vectors, comment_sentiment, stream_score,
    )
}

_FOLDED = f"""
    r AS (SELECT doc_id, length(bin(n_chars)) AS bucket, toxic,
        CASE WHEN toxic IS NOT NULL THEN {T.hash_sql('doc_id', 1)} % 5 END AS fold
        FROM documents LEFT JOIN labels USING (doc_id))"""

ORACLES = {
    "oof_target_mean": f"""
        WITH {_FOLDED},
        m AS (SELECT bucket, i, avg(toxic) FILTER (fold <> i) AS m
              FROM r, (SELECT unnest(range(5)) AS i) GROUP BY bucket, i),
        a AS (SELECT bucket, avg(m) AS m FROM m GROUP BY bucket)
        SELECT doc_id, round(CASE WHEN fold IS NOT NULL THEN m.m ELSE a.m END, 9) AS blend
        FROM r LEFT JOIN m ON r.bucket = m.bucket AND r.fold = m.i LEFT JOIN a ON r.bucket = a.bucket""",
}
