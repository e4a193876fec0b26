"""Join, split, fold and score queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinegrade.catalog import tables as T
from cinegrade.operators import joins as J
from cinegrade.operators import scores as S
from cinegrade.operators import splits as P
from cinegrade.plans.ratings import extract_labels


def _files(spark, d):
    return T.table(spark, d, "documents").select(T.document_path().alias("path"), "n_chars")


def _labels(spark, d):
    return extract_labels(T.labels(spark, d))


def join_labels(spark, d):
    return J.join_labels(_files(spark, d), _labels(spark, d)).select("file_id", "path", "n_chars", "rating")


def broadcast_lookup(spark, d):
    return J.lookup_labels(_files(spark, d), _labels(spark, d)).select("file_id", "path", "n_chars", "rating")


def semi_split(spark, d):
    """Labelled documents restricted to the keys of the test side."""
    _, test = P.train_test_split(T.labels(spark, d), "file_id")
    return join_labels(spark, d).join(test.select("file_id"), "file_id", "left_semi")


def _category(spark, d, name):
    return T.table(spark, d, "labels").select(
        F.col("doc_id").cast("string").alias("file_id"), F.col(name).cast("double").alias("prediction")
    )


def holdout_anti(spark, d):
    return J.train_and_holdout(_files(spark, d), _category(spark, d, "toxic"))[1].select("file_id", "path")


def train_rows(spark, d):
    return J.train_and_holdout(_files(spark, d), _category(spark, d, "toxic"))[0].select("file_id", "path", "prediction", "n_chars")


def _rule_scores(spark, d, folds=5):
    """One score per document and model: the model's number against the text length."""
    docs = T.table(spark, d, "documents").select("doc_id", "n_chars")
    models = F.explode(F.sequence(F.lit(1), F.lit(folds)))
    scored = docs.select("doc_id", "n_chars", models.alias("model"))
    return scored.withColumn("score", F.col("model") / (F.col("n_chars") + F.col("model")))


def holdout_average(spark, d):
    held_out = _rule_scores(spark, d).join(T.table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")
    return J.average_scores(held_out, "doc_id").select("doc_id", F.round("score", 9).alias("score"))


def blend_union(spark, d):
    """Averaged scores of unlabelled rows and own-fold scores of labelled rows, as one column."""
    own = P.with_fold(_rule_scores(spark, d), "doc_id", 5, seed=1).where(F.col("fold") + 1 == F.col("model"))
    own = own.join(T.table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    return holdout_average(spark, d).unionByName(own.select("doc_id", F.round("score", 9).alias("score")))


def wide_features(spark, d):
    long = T.table(spark, d, "labels").unpivot("doc_id", ["quality", "toxic"], "category", "score")
    return J.widen(long, "doc_id", ["quality", "toxic"])


def accuracy(spark, d):
    """Accuracy of a length rule against the quality label."""
    rows = T.table(spark, d, "documents").join(T.table(spark, d, "labels"), "doc_id")
    scored = rows.select(F.col("quality").alias("label"), (F.col("n_chars") > 1000).cast("int").alias("prediction"))
    return scored.agg(F.round(S.accuracy(), 9).alias("accuracy"))


def confusion_rates(spark, d):
    docs = T.table(spark, d, "documents").select("doc_id", "n_chars")
    long = T.table(spark, d, "labels").unpivot("doc_id", ["quality", "toxic"], "category", "label")
    rule = (F.col("n_chars") > 1000).cast("int").alias("prediction")
    rates = S.confusion_rates(docs.join(long, "doc_id").select("category", "label", rule), "category")
    exact = ["category", "tp", "fp", "tn", "fn"]
    return rates.select(*exact, *[F.round(c, 9).alias(c) for c in rates.columns if c not in exact])


def class_balance(spark, d):
    share = S.class_share(_labels(spark, d), "rating", "R")
    return share.select("n", F.round("share", 9).alias("share"))


def label_index(spark, d):
    indexed = S.label_index(T.labels(spark, d), "rating")
    return indexed.select("file_id", "rating", F.col("label_index").cast("long").alias("label_index"))


def kfold_assign(spark, d):
    folded = P.with_fold(T.table(spark, d, "documents").select("doc_id"), "doc_id", 5, seed=3)
    return folded.select("doc_id", F.col("fold").cast("long").alias("fold"))


def fold_train_sizes(spark, d):
    """Rows per test fold and in the training part that goes with it.

    Each row is counted once; the training size is the total minus the fold.
    """
    folded = P.with_fold(T.labels(spark, d), "file_id", 5, seed=3)
    sizes = folded.groupBy("fold").agg(F.count("*").alias("n_test"))
    total = sizes.agg(F.sum("n_test").alias("total"), F.collect_list(F.struct("fold", "n_test")).alias("folds"))
    return total.select("total", F.inline("folds")).select(
        F.col("fold").cast("long").alias("fold"), "n_test", (F.col("total") - F.col("n_test")).alias("n_train")
    )


def sample_fraction(spark, d):
    return P.sample_fraction(T.table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id", 0.5, seed=1)


def train_test_split(spark, d):
    train, test = P.train_test_split(T.labels(spark, d), "file_id", 0.2, seed=1)
    return train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))


QUERIES = {
    f.__name__: f
    for f in (
        join_labels, broadcast_lookup, semi_split, holdout_anti, train_rows, holdout_average,
        blend_union, wide_features, accuracy, confusion_rates, class_balance, label_index,
        kfold_assign, fold_train_sizes, sample_fraction, train_test_split,
    )
}

_BINARY = f"SELECT doc_id, file_id, CASE WHEN rating = 'R' THEN 'R' ELSE 'NOT_R' END AS rating FROM ({T.VALID_SQL})"
_JOINED = f"""
    SELECT file_id, {T.PATH_SQL} AS path, n_chars, rating FROM documents JOIN ({_BINARY}) l USING (doc_id)"""
_UNIT = f"{T.hash_sql('file_id', 1)} / 4294967296.0::DOUBLE"
_AVERAGE = """SELECT doc_id, round(avg(m / (n_chars + m)::DOUBLE), 9) AS score
    FROM documents, (SELECT unnest(range(1, 6)) AS m)
    WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY doc_id"""
_COUNTS = "count(*) FILTER (label = {0} AND said = {1})"

ORACLES = {
    "join_labels": _JOINED,
    "broadcast_lookup": _JOINED,
    "semi_split": f"SELECT * FROM ({_JOINED}) WHERE {_UNIT} < 0.2",
    "holdout_anti": f"""
        SELECT CAST(doc_id AS VARCHAR) AS file_id, {T.PATH_SQL} AS path FROM documents
        WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "train_rows": f"""
        SELECT CAST(doc_id AS VARCHAR) AS file_id, {T.PATH_SQL} AS path, CAST(toxic AS DOUBLE) AS prediction, n_chars
        FROM documents JOIN labels USING (doc_id)""",
    "holdout_average": _AVERAGE,
    "blend_union": f"""{_AVERAGE} UNION ALL
        SELECT doc_id, round((f + 1) / (n_chars + f + 1)::DOUBLE, 9) AS score
        FROM (SELECT doc_id, n_chars, {T.hash_sql('doc_id', 1)} % 5 AS f FROM documents)
        WHERE doc_id IN (SELECT doc_id FROM labels)""",
    "wide_features": "SELECT doc_id, quality, toxic FROM labels",
    "accuracy": """
        SELECT round(avg(CASE WHEN quality = CAST(n_chars > 1000 AS INT) THEN 1.0 ELSE 0.0 END), 9) AS accuracy
        FROM documents JOIN labels USING (doc_id)""",
    "confusion_rates": f"""
        WITH l AS (SELECT doc_id, 'quality' AS category, quality AS label FROM labels
            UNION ALL SELECT doc_id, 'toxic', toxic FROM labels),
        c AS (SELECT category, {_COUNTS.format(1, 1)} AS tp, {_COUNTS.format(0, 1)} AS fp,
                {_COUNTS.format(0, 0)} AS tn, {_COUNTS.format(1, 0)} AS fn
            FROM (SELECT category, label, CAST(n_chars > 1000 AS INT) AS said FROM documents JOIN l USING (doc_id))
            GROUP BY category)
        SELECT category, tp, fp, tn, fn, round((tp + tn)::DOUBLE / (tp + fp + tn + fn), 9) AS accuracy,
            round(tp::DOUBLE / nullif(tp + fp, 0), 9) AS precision, round(fp::DOUBLE / nullif(fp + tn, 0), 9) AS fp_rate,
            round(tp::DOUBLE / nullif(tp + fn, 0), 9) AS tp_rate FROM c""",
    "class_balance": f"""
        SELECT count(*) AS n, round(avg(CASE WHEN rating = 'R' THEN 1.0 ELSE 0.0 END), 9) AS share FROM ({_BINARY})""",
    "label_index": f"SELECT file_id, rating, dense_rank() OVER (ORDER BY rating) - 1 AS label_index FROM ({T.LABELS_SQL})",
    "kfold_assign": f"SELECT doc_id, {T.hash_sql('doc_id', 3)} % 5 AS fold FROM documents",
    "fold_train_sizes": f"""
        SELECT fold, n AS n_test, CAST(sum(n) OVER () - n AS BIGINT) AS n_train
        FROM (SELECT {T.hash_sql('doc_id', 3)} % 5 AS fold, count(*) AS n FROM labels GROUP BY 1)""",
    "sample_fraction": f"""
        SELECT doc_id, n_chars FROM documents WHERE {T.hash_sql('doc_id', 1)} / 4294967296.0::DOUBLE < 0.5""",
    "train_test_split": f"""
        SELECT file_id, rating, CASE WHEN {_UNIT} < 0.2 THEN 'test' ELSE 'train' END AS side FROM ({T.LABELS_SQL})""",
}
