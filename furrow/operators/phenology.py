"""Season statistics of index series.

Inputs have at most one row per (parcel, date, index), so a series is bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _earliest_max(out: Column, value: Column, at: Column) -> Column:
    return F.max_by(out, F.struct(value, -at))


def _earliest_min(out: Column, value: Column, at: Column) -> Column:
    return F.min_by(out, F.struct(value, at))


def phenology(agg: DataFrame) -> DataFrame:
    """Statistics, peak and trough day and area under the curve per (parcel, index).

    The window and the aggregation share their keys: one exchange and one sort serve all of them.
    """
    series = Window.partitionBy("parcel_id", "idx").orderBy("doy", "date")
    rows = (
        agg.where(F.col("date").isNotNull() & F.col("value").isNotNull())
        .select("parcel_id", "idx", "date", "value", F.dayofyear("date").cast("double").alias("doy"))
        .withColumn("_next_doy", F.lead("doy").over(series))
        .withColumn("_next", F.lead("value").over(series))
    )
    area = 0.5 * (F.col("value") + F.col("_next")) * (F.col("_next_doy") - F.col("doy"))
    day, value, doy = F.unix_date("date"), F.col("value"), F.col("doy")
    return rows.groupBy("parcel_id", "idx").agg(
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.median(value).alias("median"),
        (F.max(value) - F.min(value)).alias("amp"),
        _earliest_max(doy, value, day).alias("doy_peak"),
        _earliest_min(doy, value, day).alias("doy_trough"),
        F.coalesce(F.sum(area), F.lit(0.0)).alias("auc"),
    )


def phenology_stats(agg: DataFrame) -> DataFrame:
    return phenology(agg).select("parcel_id", "idx", "mean", "std", "min", "max", "median", "amp")


def peak_doy(agg: DataFrame) -> DataFrame:
    return phenology(agg).select("parcel_id", "idx", "doy_peak")


def trough_doy(agg: DataFrame) -> DataFrame:
    return phenology(agg).select("parcel_id", "idx", "doy_trough")


def auc_trapezoid(agg: DataFrame) -> DataFrame:
    return phenology(agg).select("parcel_id", "idx", "auc")


def drop_padding(wide: DataFrame, features: Iterable[str]) -> DataFrame:
    """Drop dates whose feature values are all the same: what interleaved gap filling leaves."""
    cols = [F.col(f) for f in features]
    return wide.where(F.greatest(*cols) != F.least(*cols))


def temporal_summary(wide: DataFrame, features: Iterable[str], keep: Iterable[str] = ()) -> DataFrame:
    """Nine statistics per feature over the valid rows of each parcel (one row per date).

    All features travel in one row, so one window and one aggregation do the work. Parcels
    without a valid row do not appear.
    """
    features = list(features)
    series = Window.partitionBy("parcel_id").orderBy("date")
    rows = (
        wide.withColumn("_doy", F.dayofyear("date").cast("double"))
        .withColumn("_pos", F.row_number().over(series) - 1)
        .withColumn("_step", F.lead("_doy").over(series) - F.col("_doy"))
        .withColumns({f"_next_{f}": F.lead(f).over(series) for f in features})
    )
    n, pos = F.count(F.lit(1)), F.col("_pos")
    aggs = []
    for f in features:
        v = F.col(f)
        area = 0.5 * (v + F.col(f"_next_{f}")) * F.col("_step")
        rise = (F.max_by(v, pos) - F.min_by(v, pos)) / F.greatest(n - 1, F.lit(1))
        aggs += [
            F.avg(v).alias(f"{f}_mean"),
            F.max(v).alias(f"{f}_max"),
            F.min(v).alias(f"{f}_min"),
            F.stddev_pop(v).alias(f"{f}_std"),
            (F.max(v) - F.min(v)).alias(f"{f}_amplitude"),
            _earliest_max(F.col("_doy"), v, pos).alias(f"{f}_peak_doy"),
            (_earliest_max(pos, v, pos) / F.greatest(n - 1, F.lit(1))).alias(f"{f}_peak_pos"),
            F.coalesce(F.sum(area), F.lit(0.0)).alias(f"{f}_auc"),
            rise.alias(f"{f}_mean_diff"),
        ]
    return rows.groupBy("parcel_id", *keep).agg(n.alias("n_valid_dates"), *aggs)
