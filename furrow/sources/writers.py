"""Table sinks and the summaries written next to them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: tuple[str, ...] = ()) -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def append_training(df: DataFrame, path: str, batch: str) -> None:
    """Add a batch to the training table, one folder per tile and batch. A batch that is written again takes its own place.

    The rebalance hint gathers small tiles into few files and splits a tile that holds most rows.
    """
    rows = df.withColumn("batch", F.lit(batch)).hint("rebalance", "tile")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tile", "batch").parquet(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per row; nested columns stay nested."""
    df.write.mode(mode).json(path)


def write_text(df: DataFrame, path: str, line: str = "line", mode: str = "overwrite") -> None:
    """An ordered report, in one file."""
    df.select(line).coalesce(1).write.mode(mode).text(path)


def write_metrics(spark: SparkSession, metrics: dict, path: str, mode: str = "overwrite") -> None:
    """One nested metrics dict as a JSON document."""
    spark.createDataFrame([(json.dumps(metrics),)], "value string").coalesce(1).write.mode(mode).text(path)


def metrics_row(scores: DataFrame) -> DataFrame:
    """A row of scores as one JSON text column."""
    return scores.select(F.to_json(F.struct(*scores.columns)).alias("value"))


def ingest_summary(read: DataFrame, written: DataFrame) -> DataFrame:
    """Rows read and written, and what the written rows hold."""
    return written.agg(
        F.count(F.lit(1)).alias("rows_written"),
        F.count_distinct("parcel_id").alias("n_parcels"),
        F.count_distinct("label").alias("n_labels"),
        F.count_distinct(F.when(F.col("label_group") != "", F.col("label_group"))).alias("n_groups"),
    ).withColumn("rows_read", read.agg(F.count(F.lit(1))).scalar())


def dataset_summary(prepared: DataFrame) -> DataFrame:
    """Sizes of a prepared table and of its splits."""

    def rows(split: str):
        return F.count_if(F.col("split") == split).alias(f"n_{split}")

    return prepared.agg(
        F.count(F.lit(1)).alias("n_parcels"),
        F.max(F.size("observed")).alias("n_steps"),
        F.max(F.size(F.get("features", F.lit(0)))).alias("n_features"),
        F.count_distinct("label_id").alias("n_classes"),
        F.count_distinct(F.when(F.col("group_id") >= 0, F.col("group_id"))).alias("n_groups"),
        rows("train"),
        rows("val"),
        rows("test"),
    )
