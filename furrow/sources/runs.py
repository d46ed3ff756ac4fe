"""Collection of the metric files of many runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def collect_runs(spark: SparkSession, glob: str, scores: Sequence[str] = ("accuracy", "f1_macro", "f1_weighted")) -> DataFrame:
    """One row per metrics file: its run folder, write time and scores."""
    files = spark.read.option("multiLine", True).schema(", ".join(f"{s} double" for s in scores)).json(glob)
    path = F.col("_metadata.file_path")
    return files.select(
        F.element_at(F.split(path, "/"), -2).alias("run"),
        path.alias("path"),
        F.col("_metadata.file_modification_time").alias("written"),
        *scores,
    )


def newest_run(runs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The latest run, overall or per variant."""
    row = F.max_by(F.struct(*[c for c in runs.columns if c not in by]), F.struct("written", "path"))
    return runs.groupBy(*by).agg(row.alias("_r")).select(*by, "_r.*")
