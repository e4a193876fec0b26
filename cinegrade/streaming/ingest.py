"""Arriving records, each key inserted once, whatever is repeated."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructType

from cinegrade.sources.writers import absent_records

MARK = "batch_id"


def _schema(records: DataFrame) -> StructType:
    return StructType([*records.schema.fields, *StructType().add(MARK, LongType()).fields])


def insert_batch(records: DataFrame, batch: int, path: str, key: str, order: Iterable[str]) -> None:
    """Write the records with new keys as the folder of their batch.

    A batch is compared with all batches but itself and replaces its own folder whole, so a batch that is run again
    after a failure, or by mistake, leaves the table as it was.
    """
    spark = records.sparkSession
    try:
        stored = spark.read.schema(_schema(records)).parquet(path).where(F.col(MARK) != batch).drop(MARK)
    except AnalysisException:  # the first batch
        stored = records.limit(0)
    absent_records(records, stored, key, order).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{MARK}={batch}")


def inserted(records: DataFrame, path: str) -> DataFrame:
    """The table at `path`, with the columns of records."""
    return records.sparkSession.read.schema(_schema(records)).parquet(path).drop(MARK)


def insert_arriving(
    stream: DataFrame, path: str, key: str, order: Iterable[str], checkpoint: str, once: bool = True
) -> StreamingQuery:
    """Insert the first record of every key that is not stored yet, batch by batch."""
    order = list(order)
    writer = stream.writeStream.foreachBatch(lambda records, batch: insert_batch(records, batch, path, key, order))
    writer = writer.option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")
    return writer.start()
