"""Language identification by bit-sliced Bloom filters of character n-grams.

One filter serves all languages: position p holds a mask with one bit for each language. Looking an
n-gram up is the AND of the masks at its HASHES positions, which gives all languages that contain it
at once. The language of a text is the one whose bit is set for most of its n-grams, after each
language's count is corrected for false positives: a share f of set bits makes f ** HASHES of absent
n-grams look present.

A language contains an n-gram if it makes up LEAST_SHARE of the n-grams of that language's text, and
LEAST_RATIO of its largest share in any language. So a language has at most 1 / LEAST_SHARE n-grams
however much text there is, and the filter's size is fixed by SLOTS.

N-grams are those of 1 to 3 letters of lower-cased words with a mark at either end. Counting is by
word: tasks add words up before they give n-grams to the shuffle.

Defined cases: null text or text without a letter is `und` with score 0; a text none of whose
n-grams is known gets the first language by name with score 0; rows with null text or language teach
nothing; without any taught language all is `und`; ties go to the first language by name; rows may
repeat; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinegrade.llm.common import Memo, slices, texts, written

SIZES = (1, 2, 3)
SLOTS, HASHES = 1 << 20, 3
LEAST_SHARE, LEAST_RATIO = 1e-5, 0.1
UNKNOWN = "und"
_WORDLIKE = re.compile(r"[^\W\d_]+")  # letters, and number signs such as ½ or Ⅷ
_FLUSH = 400_000
_FIELD = 40  # bits of a count in a packed number


def letter_runs(word: str) -> list[str]:
    """Runs of letters (the Unicode categories L*) of a word in lower case."""
    found = _WORDLIKE.findall(word.lower())
    if all(map(str.isalpha, found)):
        return found
    return [run for part in found for run in "".join(c if c.isalpha() else " " for c in part).split(" ") if run]


def grams(word: str) -> list[str]:
    """N-grams of the letter runs of a word."""
    out = []
    for run in letter_runs(word):
        marked = f"^{run}$"
        out += run
        out += [marked[i : i + n] for n in SIZES[1:] for i in range(len(marked) - n + 1)]
    return out


def _positions(gram: str) -> list[int]:
    """The positions that the SQL expression in `_filter_rows` gives: xxhash64 with Spark's seed, halves combined."""
    h = xxhash.xxh64_intdigest(gram.encode(), seed=42)
    low, high = h & 0xFFFFFFFF, (h >> 32) | 1
    return [(low + k * high) % SLOTS for k in range(HASHES)]


@dataclass(frozen=True)
class LanguageFilter:
    """languages by bit; masks: SLOTS x words of 64 bits, as bytes."""

    languages: tuple[str, ...]
    masks: bytes

    def table(self) -> np.ndarray:
        return np.frombuffer(self.masks, dtype=np.uint64).reshape(SLOTS, -1)


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial (lang, gram, n): words are added up per language, and given out at _FLUSH different ones."""
    words: dict[str, Counter] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, counter in words.items():
            total: Counter = Counter()
            for word, n in counter.items():
                for gram in grams(word):
                    total[gram] += n
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(total)), pa.array(list(total)), pa.array(list(total.values()), pa.int64())], names=["lang", "gram", "n"])
        words.clear()

    for part in slices(batches):
        for lang, text in zip(part.column("lang").to_pylist(), texts(part.column("text"))):
            words.setdefault(lang, Counter()).update(text.split())
        if sum(map(len, words.values())) > _FLUSH:
            yield from flush()
    yield from flush()


def gram_counts(rows: DataFrame) -> DataFrame:
    """(lang, gram, n) of (lang, text) rows."""
    partial = rows.where("lang IS NOT NULL AND text IS NOT NULL").mapInArrow(_gram_counts, "lang string, gram string, n bigint")
    return partial.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def contained(counts: DataFrame) -> DataFrame:
    """(lang, gram): the n-grams that each language contains."""
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = counts.join(F.broadcast(totals), "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("share"))
    frequent = shares.where(F.col("share") >= LEAST_SHARE)
    most = frequent.groupBy(F.col("gram").alias("of")).agg(F.max("share").alias("most"))
    return frequent.join(most, frequent["gram"] == most["of"]).where(F.col("share") >= LEAST_RATIO * F.col("most")).select("lang", "gram")


def fit_filter(rows: DataFrame) -> LanguageFilter:
    """The filter of all (lang, text) rows. SLOTS rows of masks at most come to the driver, and the names of the languages."""
    held = written(contained(written(gram_counts(rows), "grams")), "contained")
    languages = tuple(sorted(r["lang"] for r in held.select("lang").distinct().collect()))
    number = F.create_map(*(F.lit(x) for pair in zip(languages, range(len(languages))) for x in pair)) if languages else F.lit(None)
    words = max(1, -(-len(languages) // 64))
    masks = np.zeros((SLOTS, words), dtype=np.uint64)
    if languages:
        hashed = held.select(F.element_at(number, F.col("lang")).alias("bit"), F.xxhash64("gram").alias("h"))
        low, high = F.expr("h & 4294967295L"), F.expr("shiftrightunsigned(h, 32) | 1L")
        spots = hashed.select("bit", F.explode(F.array(*((low + k * high) % SLOTS for k in range(HASHES)))).alias("slot"))
        found = spots.groupBy("slot", F.floor(F.col("bit") / 32).alias("half")).agg(F.bit_or(F.expr("shiftleft(1L, bit % 32)")).alias("mask")).toPandas()
        halves = np.zeros((SLOTS, 2 * words), dtype=np.uint32)
        halves[found["slot"].to_numpy(np.int64), found["half"].to_numpy(np.int64)] = found["mask"].to_numpy(np.int64).astype(np.uint32)
        masks = np.ascontiguousarray(halves).view(np.uint64)
    return LanguageFilter(languages, masks.tobytes())


class Judge:
    """Counts of a text's n-grams by language. The counts are fields of one number: n-grams, then each language's."""

    def __init__(self, fitted: LanguageFilter):
        self.languages, self.masks = fitted.languages, fitted.table()
        bits = np.unpackbits(self.masks.view(np.uint8), axis=1, bitorder="little")[:, : len(self.languages)]
        self.false = bits.mean(axis=0) ** HASHES
        self.grams = Memo(self._gram)
        self.words = Memo(lambda word: sum(map(self.grams.__getitem__, grams(word))))

    def _gram(self, gram: str) -> int:
        """One n-gram, and one for each language that contains it by the filter."""
        mask = np.bitwise_and.reduce(self.masks[_positions(gram)], axis=0)  # one word for each 64 languages
        return 1 + sum(1 << _FIELD * (k + 1) for k in range(len(self.languages)) if int(mask[k // 64]) >> (k % 64) & 1)

    def judge(self, text: str) -> tuple[str, float]:
        packed = sum(map(self.words.__getitem__, text.split()))
        total = packed & ((1 << _FIELD) - 1)
        if not total or not self.languages:
            return UNKNOWN, 0.0
        counts = np.array([packed >> _FIELD * (k + 1) & ((1 << _FIELD) - 1) for k in range(len(self.languages))])
        corrected = np.clip((counts - total * self.false) / np.maximum(1 - self.false, 1e-9), 0, total)
        best = int(np.argmax(corrected))
        return self.languages[best], float(corrected[best] / total)


@lru_cache(maxsize=1)
def _judge(fitted: LanguageFilter) -> Judge:
    return Judge(fitted)


def _predicted(batches: Iterator[pa.RecordBatch], fitted: LanguageFilter) -> Iterator[pa.RecordBatch]:
    judge = _judge(fitted)
    for part in slices(batches):
        found = [judge.judge(t) for t in texts(part.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [*part.columns[:-1], pa.array([f[0] for f in found]), pa.array([f[1] for f in found], pa.float64())],
            names=[*part.schema.names[:-1], "lang_pred", "score"])


def predict(docs: DataFrame, fitted: LanguageFilter, id_col: str = "doc_id", text_col: str = "text", **carry) -> DataFrame:
    """doc_id, carried columns, lang_pred and score of each row; only the text is looked at."""
    rows = docs.select(F.col(id_col).alias("doc_id"), *(v.alias(k) for k, v in carry.items()), F.col(text_col).alias("text"))
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    shared = rows.sparkSession.sparkContext.broadcast(fitted)
    return rows.mapInArrow(lambda b: _predicted(b, shared.value), f"{kept}, lang_pred string, score double")
