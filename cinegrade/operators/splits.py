"""Splits, folds and samples drawn from a hash of the key.

A row's side depends on its key and the seed alone. Reruns, retried tasks and other
partitionings give the same split, and no split needs a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPAN = 1 << 32


def key_hash(key: Column, seed: int = 0) -> Column:
    """32 bits of the MD5 digest of `seed:key`."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.left(digest, F.lit(8)), 16, 10).cast("bigint")


def unit_hash(key: Column, seed: int = 0) -> Column:
    """Hash of the key as a number in [0, 1)."""
    return key_hash(key, seed) / F.lit(float(_SPAN))


def with_fold(df: DataFrame, key: str, k: int, seed: int = 0, fold_col: str = "fold") -> DataFrame:
    return df.withColumn(fold_col, (key_hash(F.col(key), seed) % k).cast("int"))


def sample_fraction(df: DataFrame, key: str, fraction: float, seed: int = 1) -> DataFrame:
    """Bernoulli sample without replacement, decided per key."""
    return df.where(unit_hash(F.col(key), seed) < fraction)


def sample_to_size(df: DataFrame, key: str, n: int, seed: int = 1) -> DataFrame:
    """Bernoulli sample with n expected rows; everything if df has no more than n."""
    total = df.count()
    return df if total <= n else sample_fraction(df, key, n / total, seed)


def train_test_split(
    df: DataFrame, key: str, test_size: float = 0.2, seed: int = 1
) -> tuple[DataFrame, DataFrame]:
    u = unit_hash(F.col(key), seed)
    return df.where(u >= test_size), df.where(u < test_size)


def shuffled(df: DataFrame, key: str, epoch: int) -> DataFrame:
    """Rows in an order that looks random and differs per epoch, yet is reproducible."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(epoch)), key)
