"""Weighted resampling and augmentation of training rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions.arrays import bind
from furrow.functions.draws import draw_key, gaussian, uniform
from furrow.operators.encode import rare_weight, sampling_weight
from furrow.operators.quantiles import random_rank


def class_intervals(table: DataFrame, label: str, mass: Column) -> Column:
    """Cumulative mass per class as one array of (label, n, low, high); one entry per class."""
    up_to = Window.orderBy(label).rowsBetween(Window.unboundedPreceding, 0)
    cum = table.withColumn("_m", mass).withColumn("_hi", F.sum("_m").over(up_to))
    entries = F.array_sort(F.collect_list(F.struct(F.col("_hi").alias("hi"), (F.col("_hi") - F.col("_m")).alias("lo"), F.col(label).alias("label"), "n")))
    return cum.where(F.col("_m") > 0).agg(entries).scalar()


def _resample(train: DataFrame, weights: DataFrame, seed: int, label: str, key: str, n: int | None) -> DataFrame:
    """n draws with replacement, rows weighted by their class.

    A draw picks a class by its share of the total weight and then one row of the class by its
    random rank, so draws and rows meet in an equi join on (class, rank) that no class can skew.
    """
    spark = train.sparkSession
    table = train.groupBy(label).agg(F.count(F.lit(1)).alias("n")).join(weights.select(label, "weight"), label)
    n = train.count() if n is None else n
    intervals = class_intervals(table, label, F.col("n") * F.col("weight"))
    last = F.element_at("_all", -1)
    draws = (
        spark.range(n)
        .withColumnRenamed("id", "draw")
        .withColumn("_all", intervals)
        .withColumn("_c", bind(uniform(f"{seed}c", "draw") * last["hi"], lambda at: F.get(F.filter("_all", lambda c: c["hi"] > at), F.lit(0))))
        .withColumn("_c", F.coalesce("_c", last))
        .select(
            "draw",
            F.col("_c.label").alias(label),
            (F.floor(uniform(f"{seed}r", "draw") * F.col("_c.n")) + 1).alias("rank"),
        )
    )
    return draws.join(random_rank(train, [label], seed, key), [label, "rank"]).drop("rank")


def weighted_resample(train: DataFrame, classes: DataFrame, power: float = 1.0, seed: int = 42, label: str = "label", key: str = "parcel_id", n: int | None = None) -> DataFrame:
    return _resample(train, sampling_weight(train, classes, label, power), seed, label, key, n)


def rare_resample(train: DataFrame, classes: DataFrame, rare: DataFrame, power: float = 1.0, boost: float = 2.0, seed: int = 42, label: str = "label", key: str = "parcel_id", n: int | None = None) -> DataFrame:
    return _resample(train, rare_weight(train, classes, rare, label, power, boost), seed, label, key, n)


def weight_summary(train: DataFrame, weights: DataFrame, label: str = "label") -> DataFrame:
    """Least, greatest and mean row weight."""
    table = train.groupBy(label).agg(F.count(F.lit(1)).alias("rows")).join(weights.select(label, "weight"), label)
    return table.agg(
        F.min("weight").alias("min_sample_weight"),
        F.max("weight").alias("max_sample_weight"),
        (F.sum(F.col("weight") * F.col("rows")) / F.sum("rows")).alias("mean_sample_weight"),
    )


def mask_time_steps(cells: DataFrame, features: Iterable[str], ratio: float, seed: int = 42) -> DataFrame:
    """Hide a share of the observed steps of each parcel: at least one, rounded half to even.

    ``cells`` has one row per (parcel, t). The grid bounds a parcel's rows.
    """
    if ratio <= 0:
        return cells
    parcel = Window.partitionBy("parcel_id")
    order = Window.partitionBy("parcel_id", "observed").orderBy(draw_key(seed, "parcel_id", "t"), "t")
    n_obs = F.count_if(F.col("observed")).over(parcel)
    ranked = cells.withColumn("_n", n_obs).withColumn("_rn", F.row_number().over(order))
    k = F.greatest(F.lit(1), F.least(F.col("_n"), F.bround(F.col("_n") * F.lit(float(ratio)))))
    masked = ranked.withColumn("_hit", F.col("observed") & (F.col("_rn") <= k))
    return masked.withColumns(
        {f: F.when(F.col("_hit"), 0.0).otherwise(F.col(f)) for f in features}
        | {"observed": F.col("observed") & ~F.col("_hit")}
    ).drop("_n", "_rn", "_hit")


def jitter(cells: DataFrame, features: Iterable[str], std: float, seed: int = 42) -> DataFrame:
    """Add normal noise to the features of observed steps."""
    if std <= 0:
        return cells
    return cells.withColumns(
        {
            f: F.when(F.col("observed"), F.col(f) + std * gaussian(f"{seed}{f}", "parcel_id", "t")).otherwise(F.col(f))
            for f in features
        }
    )


def ssl_mask(cells: DataFrame, ratio: float, seed: int = 42) -> DataFrame:
    """Add ``masked``: each observed step with probability ``ratio``, at least one per parcel."""
    if ratio <= 0:
        return cells.withColumn("masked", F.lit(False))
    parcel = Window.partitionBy("parcel_id")
    order = Window.partitionBy("parcel_id", "observed").orderBy("_u", "t")
    drawn = cells.withColumn("_u", uniform(seed, "parcel_id", "t")).withColumn("_hit", F.col("observed") & (F.col("_u") < ratio))
    any_hit = F.bool_or("_hit").over(parcel)
    first = F.row_number().over(order) == 1
    return (
        drawn.withColumn("_any", any_hit)
        .withColumn("_first", first)
        .withColumn("masked", F.col("_hit") | (F.col("observed") & ~F.col("_any") & F.col("_first")))
        .drop("_u", "_hit", "_any", "_first")
    )


def apply_ssl_mask(cells: DataFrame, features: Iterable[str]) -> DataFrame:
    """What the model sees: masked steps are unobserved, with features 0 and quality (0, 1, 0)."""
    hidden = F.col("masked")
    seen = F.col("observed") & ~hidden
    return cells.withColumns(
        {f: F.when(hidden, 0.0).otherwise(F.col(f)) for f in features}
        | {
            "reliability": F.when(seen, F.col("reliability")).otherwise(0.0),
            "cloud_norm": F.when(seen, F.col("cloud_norm")).otherwise(1.0),
            "px_norm": F.when(seen, F.col("px_norm")).otherwise(0.0),
            "observed": seen,
        }
    )
