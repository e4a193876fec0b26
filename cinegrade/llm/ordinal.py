"""Ordinal cumulative-link regression on graded ratings over hashed text.

One weight per hashed feature is shared by all grades; ordered thresholds t1 < t2 < ... cut the
score s of a text: P(grade >= k) = logistic(s - t_k). The expected grade is the sum of these tails
and one of them selects.

A text is its words. A word gives two features: its letters in lower case, and what it has besides
letters; a word equal to the one before it gives a third. s is the sum of the words' weights over
the root of their number, so single telling words count in long texts too. Because s is a sum over
words, a word's weight is looked up once and remembered.

The fit uses a bounded sample of rated documents (MAX_ROWS, by hash of the id) whose hashed counts,
at most MAX_ROWS x BUCKETS numbers, go to the driver; all documents are scored.

Defined cases: null or wordless text has s = 0; ratings with a null id or grade are not used. Where no
rating, or every rating, reaches a grade, nothing is learned of it and its tail is 1, so nothing is
rejected on it; so it is without ratings. Rows may repeat; an empty table gives no rows. Few ratings
give small weights, as the penalty is shared by all of them.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, islice, repeat
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinegrade.llm.common import Memo, slices, texts
from cinegrade.llm.tree_rules import labelled_sample

MAX_ROWS = 8_000
GRADES = 3  # that grades_of gives
BUCKETS = 1 << 16
_LETTERS = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> tuple[int, ...]:
    """Buckets of a word: its letters, and its other characters if it has any."""
    letters = "".join(_LETTERS.findall(word)).lower()
    rest = _LETTERS.sub("", word)
    named = (["w " + letters] if letters else []) + (["r " + rest] if rest else [])
    return tuple(zlib.crc32(n.encode("utf-8", "replace")) % BUCKETS for n in named)


AGAIN = zlib.crc32(b"again") % BUCKETS
_FEATURES = Memo(word_features)


def repeats(words: list[str]) -> int:
    """Words that equal the one before them."""
    return sum(map(eq, words, islice(words, 1, None)))


def hashed_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their values: count over the root of the number of words."""
    words = text.split()
    found = np.fromiter(chain(chain.from_iterable(map(_FEATURES.__getitem__, words)), repeat(AGAIN, repeats(words))), np.int64)
    buckets, counts = np.unique(found, return_counts=True)
    return buckets, counts / np.sqrt(max(len(words), 1))


@dataclass(frozen=True)
class OrdinalModel:
    weights: bytes  # float64 by bucket
    thresholds: tuple[float, ...]

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... in columns."""
        cuts = np.array(self.thresholds)
        return np.where(np.isneginf(cuts), 1.0, 1 / (1 + np.exp(-np.clip(scores[:, None] - cuts, -35, 35))))


def fit(rows: list[tuple[float, np.ndarray, np.ndarray]], grades: int | None = None, steps: int = 150, ridge: float = 8.0, features: int = 500) -> OrdinalModel:
    """Weights and thresholds by gradient descent with momentum and adaptive steps on the mean loss.

    rows: grade, buckets and values. Grades are 0, 1, 2, ..., as many as `grades` says or the largest one shows;
    each above 0 that some ratings reach and others don't is one target of a tail.
    The `features` buckets whose covariance with a tail is the most standard errors from 0 get a weight: the best by
    rank, so few ratings are no special case. They are scaled to unit mean square for the descent, so that rare
    telling words move as fast as common ones, and by those standard errors over the largest. The penalty is
    ridge for all rows together.
    """
    given = np.array([int(r[0]) for r in rows], dtype=np.int64)
    tops = np.arange(1, max(grades or 0, given.max(initial=1) + 1))
    known = tops[[0 < (given >= k).sum() < len(given) for k in tops]]
    if not len(known):
        return OrdinalModel(np.zeros(BUCKETS).tobytes(), (-np.inf,) * len(tops))
    top = len(known)
    at = np.concatenate([r[1] for r in rows])
    value = np.concatenate([r[2] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    scale = np.sqrt(len(rows) / np.maximum(np.bincount(at, value**2, BUCKETS), 1e-12))
    reaches = (given[:, None] >= known).astype(float)
    centred = (reaches - reaches.mean(axis=0)) / np.maximum(reaches.std(axis=0), 1e-9)
    z = np.max([np.abs(np.bincount(at, c[row] * value, BUCKETS)) * scale / np.sqrt(len(rows)) for c in centred.T], axis=0)
    best = np.lexsort((np.arange(BUCKETS), -z))[:features]
    telling = np.zeros(BUCKETS)
    telling[best] = z[best] / max(z.max(), 1e-9)
    scale *= telling
    value = value * scale[at]
    share = np.clip(reaches.mean(axis=0), 1e-3, 1 - 1e-3)
    first = -np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(first), 1e-2))  # thresholds stay ordered: the gaps are exponentials
    state = np.concatenate([np.zeros(BUCKETS), first[:1], gaps])
    mean, square = np.zeros_like(state), np.zeros_like(state)
    for step in range(1, steps + 1):
        weights, cuts = state[:BUCKETS], state[BUCKETS] + np.concatenate([[0.0], np.cumsum(np.exp(state[BUCKETS + 1 :]))])
        scores = np.bincount(row, weights[at] * value, len(rows))
        error = 1 / (1 + np.exp(-np.clip(scores[:, None] - cuts, -35, 35))) - reaches
        slope = np.bincount(at, error.sum(axis=1)[row] * value, BUCKETS) / len(rows) + ridge / len(rows) * weights
        down = -error.mean(axis=0)
        steps_up = np.exp(state[BUCKETS + 1 :]) * np.array([down[k:].sum() for k in range(1, top)])
        gradient = np.concatenate([slope, [down.sum()], steps_up])
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        state = state - 0.05 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    cuts = state[BUCKETS] + np.concatenate([[0.0], np.cumsum(np.exp(state[BUCKETS + 1 :]))])
    thresholds = np.full(len(tops), -np.inf)
    thresholds[known - 1] = cuts
    return OrdinalModel((state[:BUCKETS] * scale).tobytes(), tuple(thresholds.tolist()))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        pairs = [hashed_counts(t) for t in texts(part.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [part.column("target"), pa.array([p[0].astype("<u2").tobytes() for p in pairs], pa.binary()), pa.array([p[1].astype("<f4").tobytes() for p in pairs], pa.binary())],
            names=["target", "buckets", "counts"])


def fit_ordinal(docs: DataFrame, ratings: DataFrame, grade: str = "grade", grades: int | None = None, max_rows: int = MAX_ROWS,
                id_col: str = "doc_id", text_col: str = "text", **descent) -> OrdinalModel:
    """Fit on at most max_rows rated documents; ratings has the id and the grade (0, 1, 2, ...)."""
    sample = labelled_sample(docs, ratings, grade, max_rows, id_col, text_col)
    found = sample.mapInArrow(_hashed, "target double, buckets binary, counts binary").toArrow().to_pydict()
    rows = sorted(zip(found["target"], found["buckets"], found["counts"]))  # the same order in each run
    return fit([(g, np.frombuffer(b, "<u2").astype(np.int64), np.frombuffer(c, "<f4").astype(float)) for g, b, c in rows], grades, **descent)


@lru_cache(maxsize=1)
def _word_weights(weights: bytes) -> tuple[Memo, float]:
    by_bucket = np.frombuffer(weights)
    return Memo(lambda word: float(sum(by_bucket[b] for b in word_features(word)))), float(by_bucket[AGAIN])


def scores(bodies: list[str], model: OrdinalModel) -> np.ndarray:
    weights, again = _word_weights(model.weights)
    out = np.zeros(len(bodies))
    for i, text in enumerate(bodies):
        words = text.split()
        if words:
            out[i] = (sum(map(weights.__getitem__, words)) + again * repeats(words)) / np.sqrt(len(words))
    return out


def _graded(batches: Iterator[pa.RecordBatch], model: OrdinalModel, select: int, least: float) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        tails = model.tails(scores(texts(part.column("text")), model))
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(tails.sum(axis=1)), pa.array(tails[:, select - 1]), pa.array(tails[:, select - 1] >= least)],
            names=["doc_id", "expected_grade", "tail", "kept"])


def grade(docs: DataFrame, model: OrdinalModel, select: int, least: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, expected_grade, tail = P(grade >= select) and kept = (tail >= least) of each row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lambda b: _graded(b, model, select, least), f"doc_id {kind}, expected_grade double, tail double, kept boolean")


def tail_column(text: Column, model: OrdinalModel, select: int) -> Column:
    """P(grade >= select) of a text column, for selections that keep all columns of a table."""

    @F.pandas_udf("double")
    def tail(bodies: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for body in bodies:
            yield pd.Series(model.tails(scores(body.fillna("").tolist(), model))[:, select - 1])
            del body
            pa.default_memory_pool().release_unused()

    return tail(text)


def grades_of(labels: DataFrame) -> DataFrame:
    """doc_id and grade: 0 without quality, 1 with quality but toxic, 2 with quality and not toxic.

    A null quality gives no grade; a null toxic counts as not toxic.
    """
    clean = F.coalesce(F.col("toxic"), F.lit(0)) == 0
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("quality").isNotNull() & ~clean, 1).when(F.col("quality").isNotNull(), 2).alias("grade"))
