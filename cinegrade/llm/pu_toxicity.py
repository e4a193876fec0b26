"""Toxicity by non-negative positive-unlabelled learning.

Only toxic examples are confirmed; everything else is unlabelled, toxic documents included. With the
class prior p (the share of toxic documents), the risk of a scorer on toxic (T) and unlabelled (U) text is

    p * loss(T as toxic) + max(0, loss(U as clean) - p * loss(T as clean))

The bracket is the risk on clean documents, which are never seen alone. Where it falls below zero
the model fits the sample and not the classes; a step then goes back up on that part.

A text is the set of its words' features: each word in lower case and its first LENGTHS letters, as
inflected forms share their start. Each of MEMBERS linear classifiers takes the FEATURES buckets that
differ most between its toxic and its unlabelled examples (the best by rank, so that few examples
are no special case), and is fitted in a task of its own. A score is the members' mean probability.

Bounds, all parameters: at most max_toxic toxic examples for all members and max_unlabelled rows for each,
chosen by hash of the id. Every document is scored, over its whole text.

Defined cases: null text counts as empty, and an empty or wordless text gets the members' score
for no feature; rows with a null id teach nothing; labels may repeat or contradict each other, and an id with a
1 is a toxic example; repeated rows are scored alike. The prior is the share of 1 among labels of 0 and 1; a table
that has only ones gives no share, and `prior` or ONLY_TOXIC holds. Without a toxic example or any
unlabelled text nothing is learned and every score is 0. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinegrade.llm.common import Memo, slices, texts

BUCKETS = 1 << 18
LENGTHS = (4, 5, 6)
MEMBERS, FEATURES = 3, 512
MAX_TOXIC, MAX_UNLABELLED = 3_000, 5_000
ONLY_TOXIC = 0.1
_WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> tuple[int, ...]:
    """Buckets of a lower-case word: itself, and its first letters where it is longer."""
    named = ["w " + word] + [f"p {word[:k]}" for k in LENGTHS if len(word) >= k]
    return tuple(zlib.crc32(n.encode("utf-8", "replace")) % BUCKETS for n in named)


_FEATURES = Memo(word_features)


def features(text: str) -> np.ndarray:
    """Distinct buckets of a text, ascending."""
    words = set(_WORD.findall(text.lower()))
    return np.unique(np.fromiter(chain.from_iterable(map(_FEATURES.__getitem__, words)), np.int32))


@dataclass(frozen=True)
class Member:
    buckets: tuple[int, ...]
    weights: tuple[float, ...]
    bias: float


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def risk_parts(toxic: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """The risk on toxic text and the (possibly negative) estimate of that on clean text, of raw scores."""
    return (prior * float(_softplus(-toxic).mean()),
            float(_softplus(unlabelled).mean()) - prior * float(_softplus(toxic).mean()))


def telling(toxic: list[np.ndarray], unlabelled: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray]:
    """The `most` buckets whose shares of texts differ most, in standard errors, and those over the largest; ties by bucket."""
    a, b = (np.bincount(np.concatenate(x) if x else [], minlength=BUCKETS).astype(float) for x in (toxic, unlabelled))
    pa_, pb_ = (a + 0.5) / (len(toxic) + 1), (b + 0.5) / (len(unlabelled) + 1)
    z = np.abs(pa_ - pb_) / np.sqrt(pa_ * (1 - pa_) / (len(toxic) + 1) + pb_ * (1 - pb_) / (len(unlabelled) + 1))
    z[(a == 0) & (b == 0)] = -1
    best = np.lexsort((np.arange(BUCKETS), -z))[:most]
    best = np.sort(best[z[best] >= 0])
    return best, z[best] / max(z[best].max(initial=0.0), 1e-9)


def fit_member(toxic: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, most: int = FEATURES,
               steps: int = 400, ridge: float = 0.2) -> Member:
    """One classifier by full gradient steps with momentum on the non-negative risk.

    The penalty on the weights is ridge for all toxic examples together, so it counts more where they are few;
    and less on a bucket the more telling it is.
    """
    chosen, scale = telling(toxic, unlabelled, most)
    place = np.full(BUCKETS, -1)
    place[chosen] = np.arange(len(chosen))
    kept = [(t := place[x])[t >= 0] for x in [*toxic, *unlabelled]]
    row, at = np.repeat(np.arange(len(kept)), [len(k) for k in kept]), np.concatenate(kept).astype(np.int64)
    value = scale[at]
    n_t, n = len(toxic), len(kept)
    pull = ridge / n_t
    state = np.append(np.zeros(len(chosen)), np.log(prior / (1 - prior)))
    mean, square = np.zeros_like(state), np.zeros_like(state)
    for step in range(1, steps + 1):
        z = np.bincount(row, state[:-1][at] * value, n) + state[-1]
        p, slope = _sigmoid(z), np.zeros(n)
        if risk_parts(z[:n_t], z[n_t:], prior)[1] >= 0:
            slope[:n_t] = prior * (p[:n_t] - 1) / n_t - prior * p[:n_t] / n_t
            slope[n_t:] = p[n_t:] / (n - n_t)
        else:  # back up on the part that has left its range
            slope[:n_t] = prior * p[:n_t] / n_t
            slope[n_t:] = -p[n_t:] / (n - n_t)
        gradient = np.append(np.bincount(at, slope[row] * value, len(chosen)) + pull * state[:-1], slope.sum())
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        state = state - 0.05 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return Member(tuple(chosen.tolist()), tuple((state[:-1] * scale).tolist()), float(state[-1]))


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        packed = [features(t).astype("<i4").tobytes() for t in texts(part.column("text"))]
        yield pa.RecordBatch.from_arrays([part.column("rank"), pa.array(packed, pa.binary())], names=["rank", "packed"])


def _chosen(docs: DataFrame, ids: DataFrame, most: int) -> DataFrame:
    """(rank, packed) of at most `most` rows of docs: those of the ids with the least hashes.

    The ids are cut first, so that a bounded table is broadcast and no text is shuffled.
    """
    ranked = ids.where("key is not null").distinct().select("key", F.xxhash64("key").alias("rank")).orderBy("rank", "key").limit(most)
    rows = docs.join(F.broadcast(ranked), "key").select("rank", "text").mapInArrow(_rows_of, "rank long, packed binary")
    return rows.orderBy("rank", "packed").limit(most)


def prior_of(labels: DataFrame, only_toxic: float = ONLY_TOXIC) -> float:
    """Share of 1 among the labels 0 and 1; only_toxic if there is no 0."""
    found = labels.where("target in (0, 1)").agg(F.sum("target").alias("ones"), F.count("target").alias("n")).first()
    if not found["n"] or found["ones"] == found["n"]:
        return only_toxic
    return min(max(float(found["ones"]) / found["n"], 1e-4), 0.9)


def fit_toxicity(docs: DataFrame, labels: DataFrame, target: str = "toxic", prior: float | None = None, members: int = MEMBERS,
                 max_toxic: int = MAX_TOXIC, max_unlabelled: int = MAX_UNLABELLED, id_col: str = "doc_id", text_col: str = "text",
                 **descent) -> tuple[Member, ...]:
    """Members fitted on toxic examples (target 1) and unlabelled rows of docs, each in a task of its own."""
    docs = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    labels = labels.select(F.col(id_col).alias("key"), F.col(target).cast("int").alias("target"))
    prior = prior_of(labels) if prior is None else prior
    toxic = _chosen(docs, labels.where("target = 1").select("key"), max_toxic)
    unlabelled = _chosen(docs, docs.select("key"), members * max_unlabelled)
    numbers = F.array(*[F.lit(m) for m in range(members)])
    rows = toxic.select(F.explode(numbers).alias("member"), F.lit(True).alias("toxic"), "packed").unionByName(
        unlabelled.select(F.pmod("rank", F.lit(members)).cast("int").alias("member"), F.lit(False).alias("toxic"), "packed"))

    def fitted(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["toxic", "packed"])  # the same order in each run, and so the same sums
        sides = [[np.frombuffer(b, "<i4") for b in group.loc[group.toxic == side, "packed"]] for side in (True, False)]
        if not all(sides):
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in ("buckets", "weights", "bias")})
        m = fit_member(*sides, prior, **descent)
        return pd.DataFrame({"buckets": [list(m.buckets)], "weights": [list(m.weights)], "bias": [m.bias]})

    found = rows.groupBy("member").applyInPandas(fitted, "buckets array<int>, weights array<double>, bias double").collect()
    return tuple(sorted((Member(tuple(r.buckets), tuple(r.weights), r.bias) for r in found), key=lambda m: (m.bias, m.buckets)))


@lru_cache(maxsize=1)
def _words(model: tuple[Member, ...]) -> tuple[dict[int, tuple[float, ...]], Memo]:
    """Weights by bucket, for all members; and the buckets with a weight of each word."""
    places = [dict(zip(m.buckets, m.weights)) for m in model]
    weights = {b: tuple(p.get(b, 0.0) for p in places) for b in set(chain.from_iterable(places))}
    return weights, Memo(lambda word: tuple(b for b in word_features(word) if b in weights))


def scores(bodies: list[str], model: tuple[Member, ...]) -> np.ndarray:
    """Mean probability of the members; 0 without any."""
    if not model:
        return np.zeros(len(bodies))
    weights, known = _words(model)
    out = np.zeros((len(bodies), len(model)))
    for i, text in enumerate(bodies):
        found = set(chain.from_iterable(map(known.__getitem__, set(_WORD.findall(text.lower())))))
        if found:
            out[i] = np.sum([weights[b] for b in sorted(found)], axis=0)
    return _sigmoid(out + np.array([m.bias for m in model])).mean(axis=1)


def _scored(batches: Iterator[pa.RecordBatch], model: tuple[Member, ...], least: float) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        found = scores(texts(part.column("text")), model)
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("held_out"), pa.array(found), pa.array((found >= least).astype(np.int32))],
            names=["doc_id", "held_out", "score", "predicted"])


def predict(docs: DataFrame, model: tuple[Member, ...], held_out: Column, least: float = 0.3,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 if score >= least) of each row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), held_out.alias("held_out"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lambda b: _scored(b, model, least), f"doc_id {kind}, held_out boolean, score double, predicted int")
