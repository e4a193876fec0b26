"""Scoring of newly arriving documents with a fitted model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def arriving(
    spark: SparkSession, path: str, schema: StructType | str, name_filter: str = "*.parquet", max_files: int = 1000
) -> DataFrame:
    """Stream of parquet files as they arrive below path."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name_filter)
    return reader.option("maxFilesPerTrigger", max_files).parquet(path)


def score_stream(
    stream: DataFrame,
    prepare: Callable[[DataFrame], DataFrame],
    model: PipelineModel,
    columns: list,
    output: str,
    checkpoint: str,
    once: bool = True,
    tasks: int | None = None,
) -> StreamingQuery:
    """Prepare, score and append the stream to parquet at `output`.

    `prepare` uses row-wise expressions only, so the job keeps no state. The checkpoint
    makes each input file count exactly once across restarts. `tasks` spreads micro-batches
    of few files over that many tasks.
    """
    stream = stream if tasks is None else stream.repartition(tasks)
    scored = model.transform(prepare(stream)).select(*columns)
    writer = scored.writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", output).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")
    return writer.start()
