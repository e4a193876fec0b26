"""Helpers that several operators share: tables, Arrow batches, bounded memos, unit splitting, bitmaps."""

from __future__ import annotations

import re
import weakref
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinegrade.session import scratch_path, ship_package

SLICE_ROWS = 512
BROADCAST_BYTES = 64 << 20
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def prepare(spark: SparkSession) -> None:
    """Send the package to the workers, and bound Arrow batches by bytes.

    A batch lies in memory outside the heap and in the Python worker at once, for each core; a bound
    in rows alone lets it grow with the length of the texts. A smaller bound that is set stays.
    """
    ship_package(spark)
    if not 0 < _bytes(spark.conf.get(_BATCH_SETTING)) <= BATCH_BYTES:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def _bytes(setting: str) -> int:
    """The value of a size setting, which may have a unit behind it; 0 if its unit is not of these."""
    found = re.fullmatch(r"(-?\d+)([kmgb]?)b?", setting.strip().lower())
    return int(found[1]) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30}[found[2]] if found else 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and gives Spark its size."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hinted(df: DataFrame, row_bytes: int, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint for df only if a count shows that its rows fit in max_bytes.

    row_bytes is what a row takes at most. A larger df comes back as it is: the join
    then shuffles and AQE may split hot keys.
    """
    return F.broadcast(df) if df.count() * row_bytes <= max_bytes else df


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Parts of at most `rows` rows, so that few texts exist as Python objects at a time.

    Arrow keeps the memory of batches that are gone; it is given back after each, as the worker
    waits beside the executor's other stages.
    """
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
        pa.default_memory_pool().release_unused()
    batch = None
    pa.default_memory_pool().release_unused()


def texts(column: pa.Array) -> list[str]:
    """Texts of a column, null as the empty text."""
    return column.fill_null("").to_pylist()


def utf8(column: pa.Array) -> list[bytes]:
    """UTF-8 of a column of texts, null as no bytes."""
    return column.cast(pa.binary()).fill_null(b"").to_pylist()


class Memo(dict):
    """Results of `make` by key, in two generations of at most `limit` entries, so that memory is bounded.

    A full young generation becomes the old one; what is used again moves back to the young one.
    Keys longer than `longest` are computed each time and not kept. A Python worker serves many
    stages: a memo that fills up empties all others of the process, so stale ones don't add up.
    """

    _all: list[weakref.ref] = []

    def __init__(self, make: Callable, limit: int = 200_000, longest: int = 100):
        super().__init__()
        self.make, self.limit, self.longest, self.old = make, limit, longest, {}
        Memo._all = [r for r in Memo._all if r() is not None] + [weakref.ref(self)]

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
                for other in Memo._all:
                    if (memo := other()) is not None and memo is not self and len(memo) > 1000:
                        memo.clear()
                        memo.old = {}
            self[key] = value
        return value


def keep_only(*memos: Memo) -> None:
    """Empty all memos of the process but these: a worker goes on from another stage with what that left."""
    for other in Memo._all:
        if (memo := other()) is not None and not any(memo is m for m in memos):
            memo.clear()
            memo.old = {}


_SPACE_BESIDE_SPACE = re.compile(r" \s|\s ")
_UNIT_START = re.compile(r"(?<=\S) (?=\S)")


def space_units(text: str) -> list[str]:
    """Text cut at single spaces between two characters that are not white space.

    The patterns of the byte-level vocabularies always begin a match at such a space: no
    alternative crosses a space except at its own start. The first unit stands as it is;
    each further one stands for itself with a space before it.
    """
    return _UNIT_START.split(text) if _SPACE_BESIDE_SPACE.search(text) else text.split(" ")


def bitmap(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """Bit set of a column of longs, by value mod `bits` (a power of two), as uint64 words.

    Rows meet in bits/64 sums at most; so many, and no more, come to the driver.
    """
    position = F.col(column).bitwiseAND(F.lit(bits - 1))
    words = (
        df.select(F.shiftright(position, 5).alias("word"), position.bitwiseAND(F.lit(31)).cast("int").alias("bit"))
        .groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"))
    )
    found = words.toPandas()
    out = np.zeros(bits // 32, dtype=np.uint32)
    out[found["word"].to_numpy(dtype=np.int64)] = found["mask"].to_numpy(dtype=np.int64).astype(np.uint32)
    return out


def in_bitmap(words: np.ndarray, values: np.ndarray) -> np.ndarray:
    position = values.astype(np.uint64) & np.uint64(len(words) * 32 - 1)
    return (words[(position >> np.uint64(5)).astype(np.int64)] >> (position & np.uint64(31)).astype(np.uint32)) & np.uint32(1) != 0
