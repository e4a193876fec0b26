"""Quality rules: boosted trees over document statistics, with monotonic constraints.

The statistics of a document are counts over its whole text. The trees are grown on histograms of
a bounded sample of labelled documents (MAX_ROWS, by hash of the id, so the same in each run) and
flattened into arrays of nodes: feature, threshold, left and right child, value. Scoring walks all
rows of a batch through the arrays together.

Constraints: along a feature with direction -1 the score never rises, with +1 it never falls. A
split that breaks its feature's direction is not taken, and the middle of its children's values
bounds all values below them.

Defined cases: null text counts as empty; a document without words fails the base rules; labels
with a null id or a null target are not used; a label may repeat and then counts as often; without
labels of both kinds every score is the prior, and only the base rules decide; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinegrade.llm.common import slices, utf8

MAX_ROWS = 20_000
SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = {  # direction of the score along each
    "log_words": 0, "mean_word": 0, "symbol_rate": -1, "dup_line_rate": -1, "repeat_rate": -1, "digit_rate": 0,
    "upper_rate": 0, "punctuation_rate": 0, "distinct_rate": 0, "words_per_line": 0, "short_word_rate": 0, "symbol_word_rate": -1,
}
_SYMBOL, _WORDLIKE = np.zeros(256, dtype=bool), np.zeros(256, dtype=np.int8)
_SYMBOL[list(SYMBOLS)] = True
_WORDLIKE[ord("0") : ord("9") + 1] = 1
_WORDLIKE[ord("A") : ord("Z") + 1] = 2
_WORDLIKE[list(b".,;:!?'\"()-")] = 3


def repeated_words(words: list[bytes], width: int = 3) -> tuple[int, int]:
    """Words inside windows of `width` words that occur twice or more, and distinct words."""
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if len(ids) < width:
        return 0, len(seen)
    keys = ids
    for k in range(1, width):  # a window's number: that of the window one word shorter, and the next word
        joined = keys[:-1] * len(seen) + ids[k:]
        keys = np.unique(joined, return_inverse=True)[1] if k < width - 1 and len(seen) > 1 << 20 else joined
    _, number, times = np.unique(keys, return_inverse=True, return_counts=True)
    again = np.flatnonzero(times[number] > 1)
    covered = np.zeros(len(ids) + 1, dtype=np.int32)
    np.add.at(covered, again, 1)
    np.add.at(covered, again + width, -1)
    return int((np.cumsum(covered[:-1]) > 0).sum()), len(seen)


def statistics(text: bytes) -> list[float]:
    """COUNTS, then FEATURES, of one text in UTF-8."""
    words = text.split()  # at the ASCII white space \x20 and \x09-\x0D
    n = len(words)
    raw = np.frombuffer(text, dtype=np.uint8)
    points = int(((raw & 0xC0) != 0x80).sum())
    spaces = int(((raw == 32) | ((raw >= 9) & (raw <= 13))).sum())
    symbols = int(_SYMBOL[raw].sum())
    lines = [line for line in text.split(b"\n") if line.strip(b" \t\n\r\x0b\x0c")]
    repeats, distinct = repeated_words(words)
    dup_lines = len(lines) - len(set(lines))
    kinds = np.bincount(_WORDLIKE[raw], minlength=4) if len(raw) else np.zeros(4, dtype=np.int64)
    chars, per_word = max(points - spaces, 1), max(n, 1)
    lengths = np.fromiter(map(len, words), np.int64, n)
    starts = np.flatnonzero(_SYMBOL[raw])
    symbol_words = int((np.diff(starts, prepend=-9) > 1).sum())  # runs of symbols
    return [
        n, points - spaces, symbols, dup_lines, repeats,
        np.log1p(n), (points - spaces) / per_word, symbols / chars, dup_lines / max(len(lines), 1), repeats / per_word, kinds[1] / chars,
        kinds[2] / chars, kinds[3] / chars, distinct / per_word, n / max(len(lines), 1), float((lengths <= 3).sum()) / per_word, symbol_words / per_word,
    ]


def table_of(bodies: list[bytes]) -> np.ndarray:
    return np.array([statistics(b) for b in bodies], dtype=np.float64).reshape(len(bodies), len(COUNTS) + len(FEATURES))


@dataclass
class Trees:
    """All trees as one table of nodes; a leaf is its own child, so that walking on changes nothing."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                below = x[rows, self.feature[at]] <= self.threshold[at]
                at = np.where(below, self.left[at], self.right[at])
            total += self.value[at]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -35, 35)))


def grow(x: np.ndarray, y: np.ndarray, directions: list[int], trees: int = 60, depth: int = 4, rate: float = 0.15,
         bins: int = 64, least: float = 5.0, ridge: float = 1.0) -> Trees:
    """Boosted trees of the log odds of y (0 or 1) over the columns of x."""
    prior = (y.sum() + 0.5) / (len(y) + 1)
    nodes: list[tuple[int, float, int, int, float]] = []
    roots: list[int] = []
    base = float(np.log(prior / (1 - prior)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.empty(0) for f in range(len(directions))]
    binned = [np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)]
    score = np.full(len(y), base)

    def node(rows: np.ndarray, grad: np.ndarray, hess: np.ndarray, level: int, low: float, high: float) -> int:
        weigh = lambda g, h: np.clip(-g / (h + ridge), low, high)
        g_all, h_all = grad[rows].sum(), hess[rows].sum()
        own = len(nodes)
        value = float(weigh(g_all, h_all))
        nodes.append((0, np.inf, own, own, rate * value))
        best = None
        if level < depth and h_all >= 2 * least:
            gain_of = lambda g, h, v: -(g * v + 0.5 * (h + ridge) * v * v)
            for f, direction in enumerate(directions):
                if not len(edges[f]):
                    continue
                g = np.cumsum(np.bincount(binned[f][rows], grad[rows], len(edges[f]) + 1))[:-1]
                h = np.cumsum(np.bincount(binned[f][rows], hess[rows], len(edges[f]) + 1))[:-1]
                left, right = weigh(g, h), weigh(g_all - g, h_all - h)
                gain = gain_of(g, h, left) + gain_of(g_all - g, h_all - h, right) - gain_of(g_all, h_all, value)
                gain[(h < least) | (h_all - h < least) | (direction * (right - left) < 0)] = -np.inf
                k = int(np.argmax(gain))
                if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                    best = (gain[k], f, k, float(left[k]), float(right[k]))
        if best:
            _, f, k, left_value, right_value = best
            goes_left, middle = binned[f][rows] <= k, (left_value + right_value) / 2
            bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[directions[f]]
            left_node = node(rows[goes_left], grad, hess, level + 1, *bounds[0])
            right_node = node(rows[~goes_left], grad, hess, level + 1, *bounds[1])
            nodes[own] = (f, float(edges[f][k]), left_node, right_node, 0.0)
        return own

    for _ in range(trees if 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-score))
        first = len(nodes)
        roots.append(node(np.arange(len(y)), p - y, p * (1 - p), 0, -np.inf, np.inf))
        kind = [np.array(c) for c in zip(*nodes[first:])]
        at = np.zeros(len(y), dtype=np.int64)
        for _ in range(depth):
            below = x[np.arange(len(y)), kind[0][at]] <= kind[1][at]
            at = np.where(below, kind[2][at], kind[3][at]) - first
        score = score + kind[4][at]
    columns = [np.array(c) for c in zip(*nodes)] if nodes else [np.zeros(0)] * 5
    return Trees(np.array(roots, dtype=np.int64), columns[0].astype(np.int64), columns[1], columns[2].astype(np.int64), columns[3].astype(np.int64), columns[4], depth, base)


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, rows: int, id_col: str, text_col: str) -> DataFrame:
    """(target, text) of at most `rows` labels: those whose ids have the smallest hashes.

    The labels are cut to the sample first, so a bounded table is broadcast and text never shuffles.
    """
    chosen = labels.where(F.col(target).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("key"), F.col(target).cast("double").alias("target"))
    chosen = chosen.orderBy(F.xxhash64("key"), "key", "target").limit(rows)
    return docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "key").select("target", "text")


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        x = table_of(utf8(part.column("text")))[:, len(COUNTS) :]
        yield pa.RecordBatch.from_arrays([part.column("target"), *(pa.array(c) for c in x.T)], names=["target", *FEATURES])


def fit_rules(docs: DataFrame, labels: DataFrame, target: str = "quality", max_rows: int = MAX_ROWS,
              id_col: str = "doc_id", text_col: str = "text", **growth) -> Trees:
    """Trees for the odds that target is 1, from at most max_rows labelled documents."""
    sample = labelled_sample(docs, labels, target, max_rows, id_col, text_col)
    found = sample.mapInArrow(_features, ", ".join(f"{c} double" for c in ["target", *FEATURES])).toPandas().to_numpy(dtype=np.float64)
    found = found[np.lexsort(found.T)]  # the same order in each run, and so the same sums
    return grow(found[:, 1:], found[:, 0], list(FEATURES.values()), **growth)


def _judged(batches: Iterator[pa.RecordBatch], trees: Trees, threshold: float, least_words: int, most_repeated: int) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        x = table_of(utf8(part.column("text")))
        counts = x[:, : len(COUNTS)].astype(np.int64)
        score = trees.probability(x[:, len(COUNTS) :])
        failed = (counts[:, 0] < least_words) | (100 * counts[:, 4] > most_repeated * counts[:, 0])
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), *(pa.array(c) for c in counts.T), pa.array(failed), pa.array(~failed & (score >= threshold)), pa.array(score)],
            names=["doc_id", *COUNTS, "base_failed", "kept", "score"])


def judge(docs: DataFrame, trees: Trees, threshold: float = 0.5, least_words: int = 50, most_repeated: int = 50,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base counts, base_failed, kept and score (0 to 1) of each row.

    base_failed: fewer than least_words words, or more than most_repeated per cent of them repeated.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {', '.join(f'{c} bigint' for c in COUNTS)}, base_failed boolean, kept boolean, score double"
    return rows.mapInArrow(lambda b: _judged(b, trees, threshold, least_words, most_repeated), schema)
