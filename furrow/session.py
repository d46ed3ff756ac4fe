"""Session settings and the two helpers every operator may need."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL_ROWS = 20_000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "furrow", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Split a hot key even where the join's partitioning would have served a later step.
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.session.timeZone": "UTC",
        # Percentiles, modes and lists keep hashing instead of sorting beyond 128 groups per task.
        "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def small_side(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """Broadcast a dictionary-like table if it really is small; otherwise leave it distributed.

    The table is computed once under a row limit. Beyond the limit the same DataFrame is
    returned unhinted, so the join falls back to a shuffle join (with AQE skew handling).
    """
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names for checkpoints, which all executors must reach."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder


@contextmanager
def ending_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within this block Spark deletes the shuffle files of a query when the query ends, not when it collects garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within this block Python gets so many rows at a time: for rows that hold whole blocks of a table."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut_lineage(df: DataFrame, label: str = "furrow") -> DataFrame:
    """Write to the shared folder and read back: a lost executor restarts from there, and later steps read only their columns."""
    path = scratch_path(df.sparkSession, label)
    with ending_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the rows of tables that ``cut_lineage`` wrote and nothing reads any more: an empty table takes their place."""
    for df in tables:
        spark = df.sparkSession
        for folder in sorted({path.rsplit("/", 1)[0] for path in df.inputFiles()}):
            spark.createDataFrame([], "gone int").coalesce(1).write.mode("overwrite").parquet(folder)


def scratch_path(spark: SparkSession, label: str = "furrow") -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
