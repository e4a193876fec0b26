"""Splits, term weights, naive Bayes, blending, search and streaming: values and properties."""

import math

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import MultilayerPerceptronClassifier, NaiveBayes
from pyspark.ml.feature import IDF, CountVectorizer, StringIndexer
from pyspark.ml.linalg import Vectors
from pyspark.ml.recommendation import ALS
from pyspark.sql import functions as F

from cinegrade.catalog import models as registered
from cinegrade.functions.labels import denial_label, grade, resolved_vote
from cinegrade.operators import least_squares, scores, splits, terms
from cinegrade.operators.network import SparseNetworkClassifier
from cinegrade.plans import bayes, blend, docvectors, factors, ratings, search
from cinegrade.session import broadcast_if_small, dropping_shuffles, shared_dir
from cinegrade.sources.writers import fit_unless_saved, is_published, publish
from cinegrade.streaming import ingest
from cinegrade.streaming.score import arriving, score_stream


@pytest.fixture(scope="module")
def docs(spark):
    """60 documents over two vocabularies; two thirds are labelled by the vocabulary."""
    rows = []
    for i in range(60):
        words = ["gun", "blood", "kill"] if i % 2 else ["cake", "song", "kitten"]
        bow = [words[j % 3] for j in range(i % 5 + 2)] + ["film"] * (i % 3)
        rows.append((i, bow, float(i % 2) if i % 3 else None, "R" if i % 2 else "NOT_R"))
    return spark.createDataFrame(rows, "id INT, bow ARRAY<STRING>, label DOUBLE, rating STRING").cache()


def test_split_disjoint_complete_stable(spark):
    df = spark.range(2000)
    train, test = splits.train_test_split(df, "id", 0.2, seed=4)
    a, b = ({r[0] for r in x.collect()} for x in (train, test))
    assert not a & b and len(a | b) == 2000 and 300 < len(b) < 500
    assert {r[0] for r in splits.train_test_split(df.repartition(13), "id", 0.2, seed=4)[1].collect()} == b


def test_folds_cover_and_balance(spark):
    sizes = splits.with_fold(spark.range(3000), "id", 5).groupBy("fold").count().collect()
    assert {r["fold"] for r in sizes} == set(range(5)) and all(500 < r["count"] < 700 for r in sizes)


def test_samples(spark):
    df = spark.range(4000)
    assert 1800 < splits.sample_fraction(df, "id", 0.5).count() < 2200
    assert 900 < splits.sample_to_size(df, "id", 1000).count() < 1100
    assert splits.sample_to_size(df, "id", 5000).count() == 4000


def test_shuffled_is_reproducible(spark):
    order = lambda epoch: [r[0] for r in splits.shuffled(spark.range(50), "id", epoch).collect()]
    assert order(1) == order(1) != order(2) and sorted(order(1)) == list(range(50))


def test_broadcast_only_when_small(spark):
    plan = lambda df: spark.range(10).join(df, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(broadcast_if_small(spark.range(100), 100))
    assert "strategy=broadcast" not in plan(broadcast_if_small(spark.range(101), 100))
    few = spark.range(3).withColumn("long", F.repeat(F.lit("x"), 1000))
    assert "strategy=broadcast" in plan(broadcast_if_small(few)) and "strategy=broadcast" not in plan(broadcast_if_small(few, max_bytes=2000))
    assert broadcast_if_small(spark.range(0)).count() == 0


def test_numbers_of_many_labels_follow_their_order(spark):
    names = [f"{(i * 7919) % 500:03d}" for i in range(500)]
    rows = spark.createDataFrame([(n,) for n in names + names + [None]], "rating STRING").repartition(7)
    got = scores.label_index(rows, "rating").collect()
    assert len(got) == 1000 and all(r["label_index"] == int(r["rating"]) for r in got)


def test_bucket_counts_are_those_of_the_dense_array(spark, sf_dir):
    from pyspark.ml.feature import HashingTF

    from cinegrade.catalog import tables as T
    from cinegrade.catalog.features import hashing_tf

    dense = HashingTF(inputCol="tokens", outputCol="tf", numFeatures=10000).transform(T.tokenised(spark, sf_dir))
    want = {r["doc_id"]: (np.count_nonzero(a), a.sum()) for r in dense.select("doc_id", "tf").collect() for a in [r["tf"].toArray()]}
    assert {r["doc_id"]: (r["buckets"], r["tokens"]) for r in hashing_tf(spark, sf_dir).collect()} == want


def test_idf_equals_spark_ml(docs):
    got = {r["term"]: r["tfidf"] / r["n"] for r in terms.tfidf(docs, "id", "bow", 2).collect()}
    df = {r["term"]: r["df"] for r in terms.doc_freq(docs, "bow").collect()}
    for term, weight in got.items():
        assert weight == pytest.approx(math.log(61 / (df[term] + 1)))


def test_bayes_equals_spark_ml(docs):
    params = bayes.term_parameters(docs, ["NOT_R", "R"], "rating", "bow")
    prior = bayes.priors(docs, ["NOT_R", "R"], "rating")
    ours = {r["id"]: r for r in bayes.predict(docs, params, prior, "id", "bow").collect()}
    model = Pipeline(stages=[
        CountVectorizer(inputCol="bow", outputCol="features"),
        StringIndexer(inputCol="rating", outputCol="y", stringOrderType="alphabetAsc"),
        NaiveBayes(labelCol="y"),
    ]).fit(docs)
    for r in model.transform(docs).collect():
        mine = ours[r["id"]]
        assert mine["prediction"] == ("R" if r["prediction"] else "NOT_R")
        assert r["rawPrediction"].toArray() == pytest.approx([mine["NOT_R"], mine["R"]])


def test_bayes_unknown_words_give_the_prior(spark, docs):
    params = bayes.term_parameters(docs, ["NOT_R", "R"], "rating", "bow")
    new = spark.createDataFrame([(1, ["never", "seen"]), (2, [])], "id INT, bow ARRAY<STRING>")
    prior = {"NOT_R": -0.2, "R": -1.7}
    got = bayes.predict(new, params, prior, "id", "bow").collect()
    assert {(r["id"], r["prediction"], r["R"]) for r in got} == {(1, "NOT_R", -1.7), (2, "NOT_R", -1.7)}


def light(model="log_reg"):
    return ratings.rating_pipeline(model, 64, {"min_doc_freq": 0}, **({"maxIter": 5} if model == "log_reg" else {}))


def test_blend_gives_every_row_one_value(docs):
    rows = docs.withColumn("other", 1 - F.col("label")).withColumnRenamed("label", "violent")
    got = blend.blend_all(rows, light(), "id", ["violent", "other"], k=3).collect()
    assert sorted(r["id"] for r in got) == list(range(60))
    assert all(0 <= r[c] <= 1 for r in got for c in ("violent", "other"))


def test_blend_is_out_of_fold(docs):
    """Turning the labels of one fold changes its own predictions not at all."""
    rows = docs.withColumnRenamed("label", "y")
    fold = blend.fold_of("id", "y", 3, 1)
    turned = rows.withColumn("y", F.when(fold == 0, 1 - F.col("y")).otherwise(F.col("y")))
    value = lambda df: {r["id"]: r["y"] for r in blend.blend_all(df, light(), "id", ["y"], k=3).collect()}
    before, after = value(rows), value(turned)
    own = {r["id"] for r in rows.where(fold == 0).collect()}
    assert own and all(before[i] == pytest.approx(after[i], abs=1e-6) for i in own)
    assert any(abs(before[i] - after[i]) > 0.01 for i in before if i not in own)


def test_fold_predictions(docs):
    got = blend.fold_predictions(docs.withColumnRenamed("label", "y"), light(), "id", "y", k=3).collect()
    per_row = {}
    for r in got:
        per_row.setdefault(r["id"], []).append(r["fold"])
    assert all(len(f) == (3 if i % 3 == 0 else 1) for i, f in per_row.items()) and len(per_row) == 60


def test_dimension_models_and_final(docs):
    rows = docs.withColumn("calm", 1 - F.col("label")).withColumnRenamed("label", "violent")
    got = blend.dimension_models(rows, light(), "id", ["violent", "calm"])
    assert got.columns == ["id", "p_violent", "p_calm"] and got.count() == 60
    features = got.join(rows.select("id", "violent"), "id")
    model, score = blend.final_model(features, ["p_violent", "p_calm"], "id", "violent", max_iter=2)
    assert score == 1.0 and model.transform(features).count() == 60


@pytest.mark.parametrize("model", ["naive_bayes", "log_reg", "gbt", "rf", "mlp"])
def test_each_classifier(docs, model):
    params = {"gbt": {"maxIter": 2}, "mlp": {"maxIter": 30, "layers": [64, 4, 2]}, "log_reg": {"maxIter": 5}}.get(model, {})
    rows = docs.withColumn("label", (F.col("rating") == "R").cast("double"))
    _, scored = ratings.fit_and_predict(rows, model, key="id", num_features=64, **params)
    out = scored.select("id", "prediction", ratings.probability(1).alias("p")).collect()
    assert out and all(0 <= r["p"] <= 1 for r in out) and len({r["id"] for r in out}) == len(out)


def _vectors(spark, n=500):
    draw = np.random.default_rng(0)
    rows = []
    for i in range(n):
        at = np.sort(draw.choice(40, 6, replace=False))
        label, numbers = i % 3, draw.random(6) + (at % 3 == i % 3)
        rows.append((float(label), Vectors.sparse(40, at.tolist(), numbers.tolist()) if i % 4 else Vectors.dense(np.bincount(at, numbers, 40))))
    return spark.createDataFrame(rows, ["label", "features"]).repartition(3).persist()


@pytest.mark.parametrize("layers", [[40, 3], [40, 5, 3], [40, 6, 4, 3]])
def test_sparse_network_equals_that_of_spark(spark, layers):
    """Sparse and dense rows, full and partial blocks, the steps of the optimiser."""
    data, settings = _vectors(spark), {"layers": layers, "maxIter": 12, "blockSize": 64, "seed": 4}
    want, got = MultilayerPerceptronClassifier(**settings).fit(data), SparseNetworkClassifier(**settings).fit(data)
    assert np.allclose(got.weights.toArray(), want.weights.toArray(), rtol=1e-6, atol=1e-9)
    assert (got.getLayers(), got.getMaxIter(), got.numFeatures, got.numClasses) == (layers, 12, 40, 3)
    both = [m.transform(data).select("prediction").collect() for m in (got, want)]
    assert both[0] == both[1]


def test_sparse_network_needs_labels(spark):
    rows = _vectors(spark, 9)
    with pytest.raises(Exception, match="whole numbers from 0 to 1"):
        SparseNetworkClassifier(layers=[40, 2], maxIter=1).fit(rows)
    with pytest.raises(Exception, match="needs rows with a label"):
        SparseNetworkClassifier(layers=[40, 3], maxIter=1).fit(rows.withColumn("label", F.when(F.col("label") > 0, F.col("label"))))


def test_networks_hold_no_dense_rows(docs, monkeypatch):
    """Before, Spark's trainer kept every row with all its features as doubles; now it draws the start, from one row."""
    seen, fit = [], MultilayerPerceptronClassifier._fit_java
    monkeypatch.setattr(MultilayerPerceptronClassifier, "_fit_java", lambda self, rows: seen.append(rows.count()) or fit(self, rows))
    rows = docs.withColumn("label", (F.col("rating") == "R").cast("double"))
    ratings.rating_pipeline("mlp", 64, layers=[64, 4, 2], maxIter=2).fit(rows)
    assert seen == [1]


def test_shuffles_of_rounds_are_dropped(spark):
    """The setting holds inside only, also for threads side by side."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    with dropping_shuffles(spark):
        with dropping_shuffles(spark):
            assert spark.conf.get(name) == "true"
        assert spark.conf.get(name) == "true"
    assert spark.conf.get(name) == before


@pytest.mark.parametrize("options", [{"feat": "tf"}, {"scale": True}, {"ngram": 2}, {"feat": "tf", "scale": True}])
def test_feature_options(docs, options):
    out = Pipeline(stages=ratings.feature_stages(64, **options)).fit(docs).transform(docs)
    assert out.select("features").first()[0].size == 64


def test_rows_of_a_fit_are_dealt_by_their_dense_size(spark, monkeypatch):
    """Before, a task got all rows of a partition, each of which trees and networks hold with all its features."""
    rows = spark.range(100).coalesce(1)
    monkeypatch.setattr(ratings, "DENSE_BYTES", 10 * 8 * 64)
    kept = ratings.kept_for_fit(rows, 64)
    sizes = [r["n"] for r in kept.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 10 and max(sizes) <= 20 and sum(sizes) == 100 and kept.is_cached
    kept.unpersist()
    few = ratings.kept_for_fit(rows.limit(10), 64)
    assert few.rdd.getNumPartitions() == 1
    few.unpersist()


def test_dense_fits_run_one_after_the_other(docs, monkeypatch):
    """Before, four fits kept their rows at a time, at any size of the table."""
    rows = docs.withColumn("label", (F.col("rating") == "R").cast("double"))
    pools, plain = [], search.ThreadPoolExecutor
    monkeypatch.setattr(search, "ThreadPoolExecutor", lambda n: pools.append(n) or plain(n))
    monkeypatch.setattr(search, "FITS_BYTES", 1000)
    pipeline = ratings.rating_pipeline("naive_bayes", 64, {"min_doc_freq": 0})
    got = {r["fold"]: r["accuracy"] for r in search.cv_scores(rows, {"nb": pipeline}, "id", k=2).collect()}
    monkeypatch.undo()
    assert pools == [1] and got == {r["fold"]: r["accuracy"] for r in search.cv_scores(rows, {"nb": pipeline}, "id", k=2).collect()}


def test_fold_networks_hold_no_dense_rows(docs, monkeypatch):
    """Before, the networks of the comparison kept the rows of all training folds as doubles."""
    seen, fit = [], MultilayerPerceptronClassifier._fit_java
    monkeypatch.setattr(MultilayerPerceptronClassifier, "_fit_java", lambda self, rows: seen.append(rows.count()) or fit(self, rows))
    rows = docs.withColumn("label", (F.col("rating") == "R").cast("double"))
    pipeline = ratings.rating_pipeline("mlp", 64, {"min_doc_freq": 0}, layers=[64, 4, 2], maxIter=2)
    assert search.cv_scores(rows, {"mlp": pipeline}, "id", k=2).count() == 2 and seen == [1, 1]


def test_index_labels_is_alphabetic(docs):
    rows, names = ratings.index_labels(docs.drop("label"))
    assert names == ["NOT_R", "R"]
    assert {(r["rating"], r["label"]) for r in rows.collect()} == {("NOT_R", 0.0), ("R", 1.0)}


def test_search(docs):
    rows = docs.withColumn("label", (F.col("rating") == "R").cast("double"))
    got = search.cv_scores(rows, {"nb": light("naive_bayes")}, "id", k=3)
    assert [(r["model"], r["fold"]) for r in got.orderBy("fold").collect()] == [("nb", 0), ("nb", 1), ("nb", 2)]
    assert search.mean_scores(got).first()["mean_accuracy"] > 0.9
    layers = search.layer_search(rows, "id", [[32, 4, 2], [32, 2]], 32, 0, max_iter=3, fraction=0.9).collect()
    assert [r["layers"] for r in layers] == ["32-4-2", "32-2"] and all(0 <= r["accuracy"] <= 1 for r in layers)


def test_fold_scores_share_features(docs, monkeypatch):
    """Models with the same features share one IDF per fold, and each score is that of its whole pipeline fitted alone."""
    rows = docs.withColumn("label", (F.col("rating") == "R").cast("double")).persist()
    pipelines = {
        "nb": ratings.rating_pipeline("naive_bayes", 64, {"min_doc_freq": 0}),
        "lr": ratings.rating_pipeline("log_reg", 64, {"min_doc_freq": 0}, maxIter=5),
        "rare": ratings.rating_pipeline("naive_bayes", 64, {"min_doc_freq": 3}),
    }
    folded = splits.with_fold(rows, "id", 3, 1)
    want = {
        (name, fold): pipeline.fit(folded.where(F.col("fold") != fold)).transform(folded.where(F.col("fold") == fold)).agg(scores.accuracy()).first()[0]
        for name, pipeline in pipelines.items() for fold in range(3)
    }
    fits, plain = [], IDF._fit
    monkeypatch.setattr(IDF, "_fit", lambda self, frame: fits.append(self) or plain(self, frame))
    got = search.cv_scores(rows, pipelines, "id", k=3)
    assert {(r["model"], r["fold"]): r["accuracy"] for r in got.collect()} == want
    assert len(fits) == 3 * 2  # three folds, two settings


def test_registered_comparison_covers_all_models_and_rare_terms(docs, monkeypatch):
    """The registered comparison has each model at its full size, over terms of 20 documents or more."""
    given = {}
    monkeypatch.setattr(registered, "_rows", lambda spark, d: docs)
    monkeypatch.setattr(search, "cv_scores", lambda rows, pipelines, key: given.update(pipelines))
    registered.cv_scores(docs.sparkSession, "")
    assert {"gbt", "rf", "mlp"} <= set(given)
    for pipeline in given.values():
        hashed, idf = pipeline.getStages()[1:3]
        assert (hashed.getNumFeatures(), idf.getMinDocFreq()) == (10_000, 20)
    last = given["mlp"].getStages()[-1]
    assert (last.getLayers(), last.getMaxIter(), given["gbt"].getStages()[-1].getMaxIter()) == ([10_000, 100, 2], 100, 20)


def test_registered_layer_search_uses_the_defaults(docs, monkeypatch):
    given = []
    monkeypatch.setattr(registered, "_rows", lambda spark, d: docs)
    monkeypatch.setattr(search, "layer_search", lambda rows, *key, **sizes: given.append((key, sizes)))
    registered.layer_search(docs.sparkSession, "")
    assert given == [(("doc_id",), {})]


def test_model_is_saved_once(docs, tmp_path):
    rows = docs.withColumn("label", (F.col("rating") == "R").cast("double"))
    path = str(tmp_path / "model")
    first = fit_unless_saved(light("naive_bayes"), rows, path)
    again = fit_unless_saved(light("naive_bayes"), rows.where("label = 1"), path)
    assert (first.stages[-1].theta.toArray() == again.stages[-1].theta.toArray()).all()


def test_confusion_rates(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 1, 0), ("a", 0, 1), ("a", 0, 0), ("b", 1, 0)], "g STRING, label INT, prediction INT")
    got = {r["g"]: r for r in scores.confusion_rates(df, "g").collect()}
    assert (got["a"]["precision"], got["a"]["fp_rate"], got["a"]["tp_rate"], got["a"]["accuracy"]) == (0.5, 0.5, 0.5, 0.5)
    assert got["b"]["precision"] is None and got["b"]["fp_rate"] is None and got["b"]["tp_rate"] == 0.0


def test_doc_vectors_and_sentiment(docs):
    corpus = docs.select("id", F.col("bow").alias("clean_comment"), F.lit("SCARY").alias("category"), "label")
    vectors = docvectors.skip_gram_vectors(corpus, size=8, epochs=2)
    assert vectors.count() == 60 and vectors.first()["doc_vector"].size == 8
    labels = corpus.where("label IS NOT NULL").select("id", "label")
    got = docvectors.comment_sentiment(vectors, labels, ["id"]).collect()
    assert {r["id"] for r in got} == {i for i in range(60) if i % 3 == 0}


def test_long_comments_train_in_more_tasks(docs, monkeypatch):
    rows = docs.sparkSession.createDataFrame([(["a", "b"] * 50,)] * 30, "words array<string>")
    assert docvectors._tasks(rows, "words") == 2
    monkeypatch.setattr(docvectors, "WORDS_PER_TASK", 600)
    assert docvectors._tasks(rows, "words") == 5
    monkeypatch.setattr(docvectors, "WORDS_PER_TASK", 1)
    assert docvectors._tasks(rows, "words") == docs.sparkSession.sparkContext.defaultParallelism


def test_factor_vectors_separate_topics(docs):
    corpus = docs.select(F.col("id").cast("string").alias("sentence_tag"), F.col("bow").alias("clean_comment"), F.lit("SCARY").alias("category"))
    empty = docs.limit(1).select(F.lit("none").alias("sentence_tag"), F.array().cast("array<string>").alias("clean_comment"), F.lit("NUDITY").alias("category"))
    got = {r["sentence_tag"]: np.array(r["doc_vector"]) for r in factors.doc_factors(corpus.union(empty), size=6, epochs=5).collect()}
    assert len(got) == 61 and all(v.shape == (6,) for v in got.values()) and not got.pop("none").any()
    u = {int(k): v / np.linalg.norm(v) for k, v in got.items() if v.any()}
    assert len(u) > 50
    same = np.mean([u[i] @ u[j] for i in u for j in u if i < j and i % 2 == j % 2])
    other = np.mean([u[i] @ u[j] for i in u for j in u if i % 2 != j % 2])
    assert same > other + 0.3


def test_least_squares_equal_those_of_spark(spark, monkeypatch):
    """Rows with fewer and with more ratings than factors have numbers, in several blocks; no system of full size for rare words."""
    draw = np.random.default_rng(3)
    cells = {(int(u), int(i)) for u in range(40) for i in draw.integers(0, 30, 1 + u % 12)} | {(u, 30) for u in range(40)} | {(7, 31)}
    table = spark.createDataFrame([(u, i, float(draw.random() * 4 + 1e-6)) for u, i in sorted(cells)], "doc INT, item INT, pmi FLOAT").persist()
    settings = dict(rank=6, regParam=0.1, alpha=2.0, implicitPrefs=True, userCol="doc", itemCol="item", ratingCol="pmi", seed=5)
    vectors = lambda df: np.array([r["features"] for r in df.orderBy("id").collect()])
    want, start = vectors(ALS(maxIter=4, **settings).fit(table).userFactors), ALS(maxIter=0, **settings).fit(table).userFactors
    monkeypatch.setattr(least_squares, "RATINGS_PER_BLOCK", 20)
    got = vectors(least_squares.implicit_factors(table, start, "doc", "item", "pmi", 4, 0.1, 2.0))
    assert got.shape == want.shape == (40, 6) and np.abs(got - want).max() < 1e-4 * np.abs(want).max()


def _ratings(spark):
    draw = np.random.default_rng(3)
    cells = sorted({(u, int(i)) for u in range(40) for i in draw.integers(0, 30, 1 + u % 12)})
    return spark.createDataFrame([(u, i, float(draw.random() * 4 + 1e-6)) for u, i in cells], "doc INT, item INT, pmi FLOAT").persist()


def test_factors_are_sent_in_waves(spark, monkeypatch):
    """Before, all copies of a side's factors lay on disk at a time, however many."""
    table = _ratings(spark)
    start = ALS(maxIter=0, rank=6, implicitPrefs=True, userCol="doc", itemCol="item", ratingCol="pmi", seed=5).fit(table).userFactors
    solve = lambda: {r["id"]: r["features"] for r in least_squares.implicit_factors(table, start, "doc", "item", "pmi", 2).collect()}
    want, counts, plain = solve(), [], least_squares._waves
    monkeypatch.setattr(least_squares, "SENT_BYTES", 1000)
    monkeypatch.setattr(least_squares, "_waves", lambda *a: counts.append(plain(*a)) or counts[-1])
    assert solve() == want and len(counts) == 2 and all(2 < n <= 8 for n in counts)


def test_rounds_leave_no_shuffle_files(spark):
    """Before, the files of every round stayed until the driver happened to collect garbage."""
    table = _ratings(spark)
    start = ALS(maxIter=0, rank=6, implicitPrefs=True, userCol="doc", itemCol="item", ratingCol="pmi", seed=5).fit(table).userFactors.persist()
    manager = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    ids = lambda: {name.split("_")[1] for name in manager.getAllBlocks().mkString(" ").split() if name.startswith("shuffle_")}
    start.count()
    before = ids()
    least_squares.implicit_factors(table, start, "doc", "item", "pmi", 6).count()
    assert len(ids() - before) <= 4  # those of the rated rows and of the count, none of the 24 of the rounds


def test_factor_vectors_are_those_of_the_library(docs, monkeypatch):
    """Spark's solver only draws the start: its rounds take a full system for each word."""
    corpus = docs.select(F.col("id").cast("string").alias("sentence_tag"), F.col("bow").alias("clean_comment"), F.lit("SCARY").alias("category"))
    rounds, fit = [], factors.ALS._fit
    monkeypatch.setattr(factors.ALS, "_fit", lambda self, table: rounds.append(self.getMaxIter()) or fit(self, table))
    assert factors.doc_factors(corpus, size=4, epochs=2).count() == 60 and rounds == [0]


def test_shifted_information_and_dense_ids(spark):
    counts = spark.createDataFrame([("a", "x", 3), ("a", "y", 1), ("b", "y", 4)], "doc STRING, term STRING, n LONG").repartition(3)
    got = {(r["doc"], r["term"]): r["pmi"] for r in factors.shifted_information(counts, "doc", ["term"]).collect()}
    assert got == {("a", "x"): pytest.approx(np.log(3 * 8 / (4 * 3))), ("b", "y"): pytest.approx(np.log(4 * 8 / (4 * 5)))}
    ids = factors.dense_ids(counts.repartition(5, "doc"), ["doc", "term"], "id").collect()
    assert sorted(r["id"] for r in ids) == [0, 1, 2]


def test_finished_layouts_are_not_fitted_again(docs, tmp_path, monkeypatch):
    rows = docs.withColumn("label", (F.col("rating") == "R").cast("double"))
    sizes = dict(num_features=32, min_doc_freq=0, max_iter=2, fraction=0.9, progress=str(tmp_path / "progress"))
    first = search.layer_search(rows, "id", [[32, 2]], **sizes).collect()
    fitted, fit = [], search.MultilayerPerceptronClassifier
    monkeypatch.setattr(search, "MultilayerPerceptronClassifier", lambda **given: fitted.append(given["layers"]) or fit(**given))
    both = search.layer_search(rows, "id", [[32, 4, 2], [32, 2]], **sizes).collect()
    assert fitted == [[32, 4, 2]] and [r["layers"] for r in both] == ["32-4-2", "32-2"] and both[1] == first[0]
    search.layer_search(rows, "id", [[32, 2]], **{**sizes, "max_iter": 3})
    assert fitted == [[32, 4, 2], [32, 2]]  # other settings, another search


def test_models_of_categories_are_published_once(docs, tmp_path, monkeypatch):
    corpus = docs.select("id", F.col("bow").alias("clean_comment"), F.when(F.col("id") % 2 == 0, "SC/ARY").otherwise("DRUGS").alias("category"))
    store = str(tmp_path / "store")
    first = {r["id"]: r["doc_vector"] for r in docvectors.skip_gram_vectors(corpus, size=4, epochs=1, store=store).collect()}
    assert sorted(p.name for p in (tmp_path / "store").iterdir() if not p.name.startswith(".")) == ["DRUGS.vectors", "SC%2FARY.vectors"]
    monkeypatch.setattr(docvectors.Word2Vec, "fit", lambda *a: pytest.fail("fitted again"))
    again = {r["id"]: r["doc_vector"] for r in docvectors.skip_gram_vectors(corpus, size=4, epochs=1, store=store).collect()}
    assert again == first


def test_a_half_written_model_is_not_taken(spark, tmp_path):
    path = str(tmp_path / "model")
    with pytest.raises(ValueError):
        publish(spark, lambda draft: (spark.range(3).write.parquet(draft), (_ for _ in ()).throw(ValueError())), path)
    assert not is_published(spark, path)
    publish(spark, lambda draft: spark.range(3).write.parquet(draft), path)
    publish(spark, lambda draft: spark.range(9).write.parquet(draft), path)
    assert spark.read.parquet(path).count() == 3 and is_published(spark, path)


def test_logistic_dimension_scores_are_out_of_fold(docs):
    rows = docs.withColumn("even", F.when(F.col("id") % 5 > 0, (F.col("id") % 2 == 0).cast("int"))).withColumn("none", F.lit(None).cast("int"))
    got = {r["dimension"]: r for r in blend.dimension_scores(rows, light("log_reg"), "id", ["even"]).collect()}
    assert got["even"]["tp"] + got["even"]["fp"] + got["even"]["tn"] + got["even"]["fn"] == 48
    assert got["even"]["accuracy"] > 0.9 and got["even"]["precision"] > 0.9


def test_weak_labels_follow_their_order(spark):
    rows = [(1, ["Nope"], True), (2, ["so", "bad", "7", "10"], False), (3, ["mild", "2", "10"], True), (4, ["plain", "words"], True), (5, ["plain"], None), (6, [], False)]
    df = spark.createDataFrame(rows, "id INT, comment ARRAY<STRING>, flagged BOOLEAN")
    vote = resolved_vote(denial_label(F.col("comment")), grade(F.col("comment")), F.col("flagged")).alias("v")
    got = {r["id"]: (r["label"], r["vote"]) for r in df.select("id", vote).select("id", "v.*").collect()}
    assert got == {1: (0, "denial"), 2: (1, "grade"), 3: (0, "grade"), 4: (1, "flag"), 5: (None, None), 6: (0, "flag")}


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "table")
    batch = lambda *rows: spark.createDataFrame(rows, "k INT, v INT")
    state = lambda: sorted(map(tuple, ingest.inserted(batch(), path).collect()))
    ingest.insert_batch(batch((1, 5), (1, 3), (2, 9)), 0, path, "k", ["v"])
    ingest.insert_batch(batch((1, 0), (3, 7)), 1, path, "k", ["v"])
    once = state()
    assert once == [(1, 3), (2, 9), (3, 7)]
    for number, rows in ((1, batch((1, 0), (3, 7))), (0, batch((1, 5), (1, 3), (2, 9)))):
        ingest.insert_batch(rows, number, path, "k", ["v"])
        assert state() == once


def test_hashed_vocabulary(docs):
    bounded = docvectors.hashed_words("bow", 3)
    words = {w for r in docs.select(bounded.alias("w")).collect() for w in r["w"]}
    assert len(words) <= 3 and all(w.startswith("#") for w in words)


def test_stream_scores_each_file_once(spark, docs, tmp_path):
    rows = docs.withColumn("label", (F.col("rating") == "R").cast("double"))
    model = light("naive_bayes").fit(rows)
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for part in ("id < 30", "id >= 30"):
        docs.select("id", "bow").where(part).write.mode("append").parquet(source)
        stream = arriving(spark, source, "id INT, bow ARRAY<STRING>")
        score_stream(stream, lambda df: df, model, ["id", "prediction"], sink, state).awaitTermination()
    got = spark.read.parquet(sink).collect()
    assert sorted(r["id"] for r in got) == list(range(60))


def test_shared_dir_follows_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_dir(spark) == (named or spark.sparkContext.getCheckpointDir())


def test_only_labelled_rows_are_tokenised_for_fits(docs, tmp_path):
    spark = docs.sparkSession
    spark.range(40).selectExpr("id AS doc_id", "'some words here' AS text").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(4).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic").write.parquet(f"{tmp_path}/labels.parquet")
    labelled = registered._all_rows(spark, str(tmp_path)).where("quality IS NOT NULL").select("doc_id", "bow")
    plan = labelled._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("regexp_extract_all") < plan.index("Join Inner")  # the plan is printed from the top
