"""Session settings, shared scratch space and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(name: str = "cinegrade", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Workers import the stemmer and the similarity by name, wherever the driver was started.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="cinegrade-")) / "cinegrade.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))  # Spark itself hands the file to every executor
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it in spark.checkpoint.dir.

    Only a local session without that setting gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="cinegrade-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from the written copy, whose size Spark knows."""
    return written(df, "cut")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a parquet table in the shared folder: lineage ends there, and Spark knows its size."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int = 1_000_000, max_bytes: int = 64 << 20) -> DataFrame:
    """Broadcast hint only after df was measured: at most max_rows rows, and max_bytes bytes as JSON.

    One aggregate that combines on the map side. A larger df comes back unhinted, so the join
    shuffles and AQE may split hot keys.
    """
    row_bytes = F.octet_length(F.to_json(F.struct("*")))
    size = df.select(row_bytes.alias("row_bytes")).agg(F.count("*").alias("rows"), F.coalesce(F.sum("row_bytes"), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if size["rows"] <= max_rows and size["bytes"] <= max_bytes else df


_DROP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_dropping: list[str | None] = []
_drop_lock = Lock()


@contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, an action's shuffle files go when it ends, and not whenever the driver collects garbage: for loops of many rounds.

    Whatever is read again is written or kept by the caller. Threads may be inside side by side.
    """
    with _drop_lock:
        _dropping.append(None if _dropping else spark.conf.get(_DROP, None))
        spark.conf.set(_DROP, "true")
    try:
        yield
    finally:
        with _drop_lock:
            before = _dropping.pop()
            if not _dropping:
                spark.conf.unset(_DROP) if before is None else spark.conf.set(_DROP, before)


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan that is too small to occupy every core; larger ones stay as read.

    Text work is bound by the processor, and a single row group would be a single task.
    The shuffle happens only below two input splits per core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < 2 * cores else df
